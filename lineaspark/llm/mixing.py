"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Rates are the closest to 1 in relative entropy that meet every source's token target within the ceiling:
the dual has one multiplier for each source and a document of size s gets the rate min(ceiling, exp(m * s / scale)).
A document's rate depends on its source and size only, so Newton's method runs over the counts of documents
by source and size, a table that partial aggregation makes and that is far smaller than the corpus.  Rates
become copies by rounding running sums from the largest size down; then a few steps move copies between sizes, so a
source ends within half its smallest document of the target where copies allow it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

CEILING = 3
WEIGHTS = (5, 2, 1)
_NEWTON = 60


def words(text: Column) -> Column:
    r"""Number of runs of characters outside ``\x20\x09-\x0D``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes.  A source
    whose share would exceed ``ceiling`` times its size stops there and the excess goes to the others by
    weight.  With ratio r = ceiling * size / weight, those that stop are the ones with the smallest ratios:
    a source is stopped if giving it the share left by all smaller ratios exceeds its ceiling.
    """
    # One row for each source: the number of sources bounds this single sort, not the corpus (a source is a collection, not a host).
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.lit([float(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("top", F.lit(float(ceiling)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("free", F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
    w = w.withColumn("load", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stopped = F.col("free") * F.col("weight") / F.col("load") > F.col("top")
    w = w.withColumn("stopped", stopped)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("top"))).over(whole), F.lit(0.0))
    share = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(whole)
    target = F.when(F.col("stopped"), F.col("top")).otherwise(left * F.col("weight") / share)
    return w.select("source", "source_size", F.least(target, F.col("top")).alias("target"))


def _total(term: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree to the last digit."""
    return F.sum(term.cast("decimal(38,9)")).cast("double")


def _solve(counts: DataFrame, aims: DataFrame, ceiling: int) -> DataFrame:
    """(source, m): the multiplier of each source, by Newton steps kept inside a shrinking bracket."""
    near = lambda d: d["source"].eqNullSafe(F.col("s2"))
    log_top = math.log(ceiling)
    scale = counts.groupBy("source").agg((_total(F.col("n") * F.col("size") * F.col("size")) / F.greatest(_total(F.col("n") * F.col("size")), F.lit(1.0))).alias("scale"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    aims = aims.join(scale.withColumnRenamed("source", "s2"), near(aims)).drop("s2")
    # At the upper end even the smallest document is at the ceiling; the lower end takes next to nothing.
    state = settle(aims.where("source_size > 0").select("source", "target", "scale", (-50.0 * F.col("scale") / F.col("least")).alias("lo"), (log_top * F.col("scale") / F.col("least")).alias("hi"), F.lit(0.0).alias("m"), F.lit(False).alias("done")))
    for _ in range(_NEWTON):
        s = state.withColumnRenamed("source", "s2")
        x = F.col("m") * F.col("size") / F.col("scale")
        rate = F.exp(F.least(x, F.lit(log_top)))
        parts = counts.join(s, counts["source"].eqNullSafe(s["s2"])).groupBy("source").agg(
            _total(F.col("n") * F.col("size") * rate).alias("took"),
            _total(F.when(x < log_top, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate).otherwise(0.0)).alias("slope"),
        )
        parts = parts.withColumnRenamed("source", "s2")
        step = state.join(parts, state["source"].eqNullSafe(parts["s2"]))
        miss = F.col("took") - F.col("target")
        lo, hi = F.when(miss < 0, F.col("m")).otherwise(F.col("lo")), F.when(miss > 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.col("m") - F.try_divide(miss, F.col("slope"))
        step = step.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("newton", newton).withColumn("done2", F.abs(miss) <= F.greatest(1e-9 * F.col("target"), F.lit(1e-6)))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        m = F.when(F.col("done2"), F.col("m")).when(inside, F.col("newton")).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        before, state = state, settle(step.select("source", "target", "scale", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), m.alias("m"), F.col("done2").alias("done")))
        discard(before)
        if not state.where("not done").limit(1).count():
            return state.select("source", "target", "scale", "m")
    raise RuntimeError(f"no rates that meet the targets after {_NEWTON} steps")


def _rounded(classes: DataFrame, ceiling: int) -> DataFrame:
    """``classes`` (source, size, n, rate, target) with total, the copies that all documents of one source and size get.

    From the largest size down, a class gets what the rounded running sum of wished copies grows by.  The sum is
    taken inside bands of sizes and over the bands, in decimals, so it does not depend on the order of adding.  Then
    each source's class whose size comes nearest to the words still missing, or too many, gives or takes copies,
    as long as that brings the source nearer to its target.
    """
    wish = (F.col("n") * F.col("rate")).cast("decimal(38,9)")
    rows = classes.withColumn("wish", wish).withColumn("band", F.floor(F.sqrt("size")).cast("int"))
    over = rows.groupBy(F.col("source").alias("s3"), F.col("band").alias("b3")).agg(F.sum("wish").alias("mass"))
    over = over.withColumn("base", F.coalesce(F.sum("mass").over(Window.partitionBy("s3").orderBy(F.desc("b3")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,9)")))
    rows = rows.join(over, rows["source"].eqNullSafe(over["s3"]) & (rows["band"] == over["b3"]))
    upto = F.col("base") + F.sum("wish").over(Window.partitionBy("source", "band").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("total", (F.round("upto") - F.round(F.col("upto") - F.col("wish"))).cast("long"))
    plan = settle(rows.select("source", "size", "n", "rate", "target", "total"))
    while True:
        miss = plan.groupBy(F.col("source").alias("s3")).agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("miss"))
        open_ = plan.join(miss, plan["source"].eqNullSafe(miss["s3"])).withColumn("far", F.abs("miss"))
        room = F.when(F.col("miss") > 0, F.col("n") * ceiling - F.col("total")).otherwise(F.col("total"))
        open_ = open_.withColumn("room", room).where("room > 0 and size < 2 * far")
        best = open_.groupBy("s3").agg(F.min_by(F.struct("size", "room", "miss", "far"), F.struct(F.abs(F.col("size") - F.col("far")), "size")).alias("x"))
        step = F.least(F.col("x.room"), F.greatest(F.lit(1), F.floor(F.col("x.far") / F.col("x.size")))) * F.signum("x.miss").cast("long")
        best = settle(best.select("s3", F.col("x.size").alias("z3"), step.cast("long").alias("step")))
        if not best.limit(1).count():
            discard(best)
            return plan.drop("target")
        moved = plan.join(best, plan["source"].eqNullSafe(best["s3"]) & (plan["size"] == best["z3"]), "left")
        before, plan = plan, settle(moved.select("source", "size", "n", "rate", "target", (F.col("total") + F.coalesce("step", F.lit(0))).alias("total")))
        discard(before)
        discard(best)


def draw_of(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix`, applied to them, decided; columns as they are."""
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(by[-1]))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), draw_of(id_col, text_col).alias("draw"))
    rows = rows.withColumn("place", place(["doc_id", "draw"]))
    wanted = mixed.withColumn("place", place(["doc_id", "draw"])).where("copies > 0").select(F.col("doc_id").alias("d2"), F.col("draw").alias("w2"), F.col("place").alias("p2"), "copies")
    match = rows["doc_id"].eqNullSafe(wanted["d2"]) & (rows["draw"] == wanted["w2"]) & (rows["place"] == wanted["p2"])
    return rows.join(wanted, match).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """doc_id, source, size (words), draw, source_size, target (of the source), rate, copies and taken for every row.

    ``taken`` is copies times size; copies lie between 0 and ``ceiling``.  Documents of one source and size
    differ by one copy at most, those with the lower hash of id and text first; equal rows that share one
    count as many.  Rows without words have no copies' worth: rate 1, one copy, nothing taken.  A null source
    is a source of its own, a null id an id like others, null text is empty.  An empty table gives an empty
    result; other columns of ``docs`` are not read.  Reruns give the same result.
    """
    draw = draw_of(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), draw.alias("draw"))
    rows = settle(rows)
    # A slice of the hash splits large classes, so that ranking one never needs a single task.
    cell = F.pmod(F.col("draw"), F.lit(1024)).cast("int")
    cells = settle(rows.withColumn("cell", cell).groupBy("source", "size", "cell").agg(F.count("*").alias("n")))
    counts = settle(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    aims = settle(targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, ceiling))
    solved = _solve(counts, aims, ceiling).withColumnRenamed("source", "s2")
    rate = F.exp(F.least(F.col("m") * F.col("size") / F.col("scale"), F.lit(math.log(ceiling))))
    plan = _rounded(counts.where("size > 0").join(solved, counts["source"].eqNullSafe(solved["s2"])).select("source", "size", "n", rate.alias("rate"), "target"), ceiling)
    base, more = F.floor(F.col("total") / F.col("n")).cast("long"), (F.col("total") % F.col("n")).cast("long")
    p = plan.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "rate", base.alias("base"), more.alias("more"))
    order = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    offset = offset.join(p, offset["source"].eqNullSafe(p["s2"]) & (offset["size"] == p["z2"])).select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("cell").alias("c2"), "rate", "base", "more", "before")
    ranked = rows.withColumn("cell", cell).withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("draw", "doc_id")))
    joined = ranked.join(offset, ranked["source"].eqNullSafe(offset["s2"]) & (ranked["size"] == offset["z2"]) & (ranked["cell"] == offset["c2"]), "left")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + (F.col("rank") + F.col("before") <= F.col("more")).cast("long"))
    goal = F.broadcast(aims.withColumnRenamed("source", "s3")) if aims.count() <= 100_000 else aims.withColumnRenamed("source", "s3")
    out = joined.select("doc_id", "source", "size", "draw", F.coalesce("rate", F.lit(1.0)).alias("rate"), copies.cast("long").alias("copies"))
    out = out.join(goal, out["source"].eqNullSafe(goal["s3"]), "left")
    return out.select("doc_id", "source", "size", "draw", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
