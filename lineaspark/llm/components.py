"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, with_group


def _least(both: DataFrame) -> DataFrame:
    """``both`` (u, v) with m, the least of u and its neighbours, also where one u has a third of all rows."""
    return with_group(both, "u", ["v"], F.min("v").alias("low")).select("u", "v", F.least("u", "low").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    to = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return to.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u long, v long), component being the least node reachable.

    Links with a null end and links of a node to itself are left out.  Each round keeps the components and
    ends when no link changes, after a number of rounds that is logarithmic in the longest path.  Each
    round's links are a table in the shared folder, so a lost executor costs one round at most.
    """
    now = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        before, now = now, settle(_small_star(_large_star(now)))
        discard(before)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
