"""Weighted sampling of windows and batches of similar size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def sampling_weights(counts: DataFrame, by_divisions: bool = False, by_dataset: bool = False, within: str | None = None) -> DataFrame:
    """``counts`` (movie, t1, n_objects, n_divs) with a probability: (1 + sqrt(n_divs)), over the movie's windows, or equal.

    ``within`` names a column in each of whose values probabilities sum to one.
    """
    w: Column = 1 + F.sqrt("n_divs") if by_divisions else F.lit(1.0)
    group = [within] if within else []
    rows = counts
    if by_dataset:
        rows = counts.join(counts.groupBy(*group, "movie").agg(F.count(F.lit(1)).alias("n_windows")), [*group, "movie"])
        w = w / (F.col("n_windows") + 1e-6)
    rows = rows.withColumn("w", w)
    total = rows.groupBy(*group).agg((F.sum("w") + 1e-10).alias("total"))
    rows = rows.join(F.broadcast(total), group) if group else rows.crossJoin(F.broadcast(total))  # one row, or one for each worker
    return rows.withColumn("prob", F.col("w") / F.col("total")).select(*counts.columns, "prob")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 digest of the parts joined by slashes, so that any engine can draw it again."""
    text = F.concat_ws("/", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def sample_windows(weighted: DataFrame, n: int, seed: int = 0, within: str | None = None, groups: int = 1) -> DataFrame:
    """``n`` draws with replacement, numbered from 0, by ``prob``.

    Windows lie one after the other on [0, 1): first inside hashed slices, then the slices.  Draws and windows
    meet by grid cells of that line, so no task sees all of either.  With ``within``, a column of numbers below ``groups``, each of its
    values has a line and ``n`` draws of its own, seeded by ``seed`` plus the value; all in one plan.
    """
    g = within or "_group"
    weighted = weighted if within else weighted.withColumn(g, F.lit(0))
    s = F.floor(_unit(F.lit("slice"), F.col("movie"), F.col("t1")) * SLICES)
    rows = weighted.withColumn("slice", s)
    slices = rows.groupBy(g, "slice").agg(F.sum("prob").alias("mass"))
    of = Window.partitionBy(g)
    before = of.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows
    slices = slices.select(g, "slice", F.coalesce(F.sum("mass").over(before), F.lit(0.0)).alias("base"), F.sum("mass").over(of).alias("whole"))
    inside = Window.partitionBy(g, "slice").orderBy("movie", "t1").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.withColumn("hi", F.sum("prob").over(inside)).join(F.broadcast(slices), [g, "slice"])  # SLICES rows for each group
    line = line.withColumn("hi", (F.col("base") + F.col("hi")) / F.col("whole")).withColumn("lo", F.col("hi") - F.col("prob") / F.col("whole"))
    cells = max(1, n)
    line = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    ids = weighted.sparkSession.range(n * groups).select((F.col("id") % n).alias("draw"), F.floor(F.col("id") / n).cast("int").alias(g))
    draws = ids.withColumn("u", _unit(seed + F.col(g), F.lit("draw"), F.col("draw"))).withColumn("cell", F.floor(F.col("u") * cells))
    hit = draws.join(line, [g, "cell"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    # At a border rounding may give a draw to two neighbours: the first one has it.
    columns = [c for c in weighted.columns if c != g]
    one = hit.groupBy(g, "draw").agg(F.min(F.struct("lo", *columns)).alias("w"))
    return one.select("draw", *[F.col(f"w.{c}").alias(c) for c in columns], *([within] if within else []))


def balanced_batches(sample: DataFrame, batch: int, n_pool: int, n: int, seed: int = 0, within: str | None = None) -> DataFrame:
    """Draws with pool, batch (in the order of training) and place; ``n`` is their number, in each value of ``within`` if given.

    Consecutive draws make pools of min(n_pool * batch, n // batch * batch); a pool is sorted by objects and cut
    into batches, the last of which may be short; the batches of a pool are shuffled.
    """
    size = max(1, min(n_pool * batch, n // batch * batch))
    own = ([within] if within else []) + ["pool"]
    rows = sample.withColumn("pool", F.floor(F.col("draw") / size))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("n_objects", "draw")) - 1
    rows = rows.withColumn("part", F.floor(rank / batch)).withColumn("place", rank % batch)
    key = _unit(seed + F.col(within) if within else F.lit(seed), F.lit("order"), F.col("pool"), F.col("part"))
    order = rows.select(*own, "part").distinct().withColumn("batch", F.row_number().over(Window.partitionBy(*own).orderBy(key, "part")) - 1)
    return rows.join(order, [*own, "part"]).drop("part")


def shard(counts: DataFrame, n_workers: int) -> DataFrame:
    """Windows dealt to workers by a digest of movie and window."""
    return counts.withColumn("worker", F.floor(_unit(F.lit("worker"), F.col("movie"), F.col("t1")) * n_workers).cast("int"))


def sample_shards(counts: DataFrame, n_workers: int, n: int, batch: int, n_pool: int, seed: int = 0, **weights: bool) -> DataFrame:
    """Batches for each worker, from its own windows, ``max(1, n / workers)`` draws each; one plan, and one scan, for all workers."""
    per = max(1, n // n_workers)
    own = sampling_weights(shard(counts, n_workers), within="worker", **weights)
    return balanced_batches(sample_windows(own, per, seed, "worker", n_workers), batch, n_pool, per, seed, "worker")
