"""Numbers in the order of some columns inside groups of any size: ranges are numbered apart and start where those before them end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .loops import materialize

RANGE_ROWS = 500_000  # rows that one task sorts, about


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str, range_rows: int | None = None) -> DataFrame:
    """``rows`` with their number from 1 in each group of ``keys``, in the given order, which must tell the rows of a group apart.

    The rows are dealt to ranges of keys and order, so a large group falls into several; each range is numbered by itself, and the
    rows of a group in the ranges before it are added.  The table of counts has a row for each range and group in it.
    """
    parts = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    cut = materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return own.join(counts, [*keys, "_range"]).withColumn(name, (F.col("_own") + F.col("_base")).cast("int")).drop("_own", "_base", "_range")
