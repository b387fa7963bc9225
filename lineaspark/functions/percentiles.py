"""Exact percentiles of large groups, by rounds of histogram refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loops import discard, materialize

BINS = 1024
BROADCAST_RANGES = 200_000  # rows, a few MB, that are broadcast at most


def exact_percentiles(rows: DataFrame, keys: list[str], column: str, at: list[float], bins: int = BINS) -> DataFrame:
    """(keys, p): for each group an array with the ``at`` quantiles of ``column``, interpolated between neighbours as usual.

    The values wanted are order statistics.  A round counts, for each of them, the values of the range it must lie in by
    ``bins`` equal bins, and goes on with the least and largest value of the bin that holds it, until these are the same.
    Counts are combined before the shuffle, so a group's largest task gets bins, not values.  Nulls are left out, groups without
    values have no row; infinite values and NaN are an error.
    """
    values = rows.select(*keys, F.col(column).cast("double").alias("v")).where("v is not null")
    fine = F.assert_true(~F.isnan("v") & (F.abs("v") < float("inf")), F.lit("percentiles need finite values"))
    values = values.where(fine.isNull())
    sizes = materialize(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")) for p in at])))
    state = materialize(sizes.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    for _ in range(200):
        left = state.where("low < high")
        if not left.limit(1).count():
            break
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        # Values of one range are counted once, whichever ranks lie in it.
        ranges = left.select(*keys, "low", "high").distinct()
        if ranges.count() <= BROADCAST_RANGES:
            ranges = F.broadcast(ranges)
        hit = values.alias("x").join(ranges.alias("s"), cond & (F.col("v") >= F.col("s.low")) & (F.col("v") <= F.col("s.high")))
        # Halves keep the width of a range finite; the last value goes to the last bin.
        share = (F.col("v") / 2 - F.col("s.low") / 2) / (F.col("s.high") / 2 - F.col("s.low") / 2)
        hit = hit.select(*[F.col(f"x.{k}") for k in keys], F.col("s.low"), F.col("s.high"), F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"), "v")
        counted = hit.groupBy(*keys, "low", "high", "bin").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("k").over(Window.partitionBy(*keys, "low", "high").orderBy("bin"))
        counted = counted.withColumn("upto", upto)
        fits = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.low") == F.col("b.low"), F.col("a.high") == F.col("b.high"), F.col("a.rank") - F.col("a.below") < F.col("b.upto"), F.col("a.rank") - F.col("a.below") >= F.col("b.upto") - F.col("b.k")]
        cond = fits[0]
        for c in fits[1:]:
            cond = cond & c
        new = left.alias("a").join(counted.alias("b"), cond).select(*[F.col(f"a.{k}") for k in keys], "a.rank", (F.col("a.below") + F.col("b.upto") - F.col("b.k")).alias("below"), F.col("b.first").alias("low"), F.col("b.last").alias("high"))
        before, state = state, materialize(state.where("low = high").unionByName(new))
        discard(before)
    else:
        raise RuntimeError("values that no histogram tells apart")
    found = state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("found"))
    same = sizes["n"].isNotNull()
    for k in keys:
        same = same & sizes[k].eqNullSafe(found[k])
    both = sizes.join(found, same).select(*[sizes[k] for k in keys], "n", "found")

    def quantile(p):
        low, high = (F.try_element_at("found", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
        part = place(p) - F.floor(place(p))
        return F.when(F.floor(place(p)) == F.ceil(place(p)), low).otherwise((1 - part) * low + part * high)

    return both.select(*keys, F.array(*[quantile(p) for p in at]).alias("p"))
