"""Sliding windows over frames, and sequences made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(detections: DataFrame, movies: DataFrame, window: int, clamp: bool = True) -> DataFrame:
    """Detections of each window of ``window`` frames, with t1, the window's first frame.

    A movie of T frames has windows for t1 = 0 .. T - w; with ``clamp`` w is at most T, else movies shorter
    than the window have none.  A detection goes to its windows by a generated sequence, without a shuffle
    beyond the join with the small table of movies.
    """
    w = F.least(F.lit(window), F.col("n_frames")) if clamp else F.lit(window)
    frames = movies.where("n_frames >= 2").select("movie", "n_frames")
    low, high = F.greatest(F.lit(0), F.col("t") - w + 1), F.least(F.col("t"), F.col("n_frames") - w)
    return detections.join(frames, "movie").where(low <= high).withColumn("t1", F.explode(F.sequence(low.cast("int"), high.cast("int")))).drop("n_frames")


def window_starts(movies: DataFrame, window: int) -> DataFrame:
    """Every window (movie, t1), those without detections too."""
    return movies.where("n_frames >= 2").select("movie", F.explode(F.sequence(F.lit(0), F.col("n_frames") - F.least(F.lit(window), F.col("n_frames")))).alias("t1"))


def relative_time(windows: DataFrame) -> DataFrame:
    """Frames counted from the window's first one that has a detection."""
    return windows.withColumn("t_rel", F.col("t") - F.min("t").over(Window.partitionBy("movie", "t1")))


def clip_tokens(windows: DataFrame, most: int) -> DataFrame:
    """Windows of more than ``most`` rows cut before a frame: the last one that starts below ``most`` goes and what follows it."""
    per = windows.groupBy("movie", "t1", "t").agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy("movie", "t1").orderBy("t")
    total = F.sum("k").over(Window.partitionBy("movie", "t1"))
    first = F.coalesce(F.sum("k").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frames = per.select("movie", "t1", "t", total.alias("total"), first.alias("first"))
    cut = frames.withColumn("cut", F.max(F.when(F.col("first") < most, F.col("first"))).over(Window.partitionBy("movie", "t1")))
    keep = cut.where(f"total <= {int(most)} or first < cut").select("movie", "t1", "t")
    return windows.join(keep, ["movie", "t1", "t"], "left_semi")


def frame_pairs(extent: DataFrame, delta_t: int = 1) -> DataFrame:
    """(movie, t, t_dst) for each frame and each distance up to ``delta_t`` inside the extent (first, stop)."""
    t = extent.select("movie", "stop", F.explode(F.sequence("first", F.col("stop") - 1)).alias("t"))
    return t.select("movie", "t", "stop", F.explode(F.sequence(F.lit(1), F.lit(delta_t))).alias("d")).where("t + d < stop").select("movie", "t", (F.col("t") + F.col("d")).alias("t_dst"))


def concat_detections(tables: list[DataFrame]) -> DataFrame:
    """Tables of detections below each other; they must have the same columns."""
    out = tables[0]
    for df in tables[1:]:
        if sorted(df.dtypes) != sorted(out.dtypes):
            raise ValueError("detections must agree in their columns")
        out = out.unionByName(df)
    return out


def pad_batches(windows: DataFrame, size: int, columns: tuple[str, ...] = ("cy", "cx")) -> DataFrame:
    """Windows in batches of ``size`` (by movie and t1), sequences padded to the batch's longest.

    Frames are padded with -1, labels and other columns with 0; ``padding`` marks padded places.
    """
    fields = F.struct("t", "label", *[F.col(c).cast("double").alias(c) for c in columns])
    seqs = windows.groupBy("movie", "t1").agg(F.sort_array(F.collect_list(fields)).alias("seq"))
    numbered = seqs.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("movie").orderBy("t1")) - 1) / size).cast("int"))
    longest = numbered.groupBy("movie", "batch").agg(F.max(F.size("seq")).alias("longest"))
    both = numbered.join(longest, ["movie", "batch"])
    gap = F.col("longest") - F.size("seq")
    pad = lambda values, fill: F.concat(values, F.array_repeat(fill, gap))
    out = [pad(F.col("seq.t"), F.lit(-1)).alias("t"), pad(F.col("seq.label"), F.lit(0)).alias("label")]
    out += [pad(F.col(f"seq.{c}"), F.lit(0.0)).alias(c) for c in columns]
    mark = pad(F.transform("seq", lambda _: F.lit(False)), F.lit(True)).alias("padding")
    return both.select("movie", "batch", "t1", *out, mark)


def padding_fraction(batches: DataFrame) -> DataFrame:
    """Per movie the share of padded places."""
    n = F.size("padding")
    padded = F.size(F.filter("padding", lambda p: p))
    return batches.groupBy("movie").agg((F.sum(padded) / F.sum(n)).alias("fraction"))
