"""Checks and clean-up of tracklet tables and label movies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def _orphans(tracklets: DataFrame) -> DataFrame:
    """Parents that are not in the table become 0."""
    known = tracklets.select("movie", F.col("label").alias("parent"), F.lit(True).alias("known")).distinct()
    return tracklets.join(known, ["movie", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")).otherwise(0)).select("movie", "label", "t1", "t2", "parent")


def clip_tracklets(tracklets: DataFrame, start: int = 0, end: int = 2**31 - 1, downscale: int = 1) -> DataFrame:
    """Tracklets that touch frames ``start`` to ``end`` (exclusive), shifted and clipped to them, parents that left set to 0.

    With ``downscale`` k only frames divisible by k remain: tracklets between two such frames go, the others
    end at floor(t2 / k) and begin at ceil(t1 / k).
    """
    if start % downscale:
        raise ValueError("start must be divisible by downscale")
    last = end - start - 1
    out = tracklets.where((F.col("t2") >= start) & (F.col("t1") < end))
    clip = lambda c: F.least(F.greatest(F.col(c) - start, F.lit(0)), F.lit(last)).cast("int")
    out = _orphans(out.withColumn("t1", clip("t1")).withColumn("t2", clip("t2")))
    if downscale > 1:
        k = downscale
        between = (F.col("t1") % k != 0) & (F.col("t2") % k != 0) & (F.floor(F.col("t1") / k) == F.floor(F.col("t2") / k))
        out = _orphans(out.where(~between)).withColumn("t2", F.floor(F.col("t2") / k).cast("int")).withColumn("t1", F.ceil(F.col("t1") / k).cast("int"))
    return out


def _by_frame(tracklets: DataFrame) -> DataFrame:
    return tracklets.select("movie", "label", F.explode(F.sequence("t1", "t2")).alias("t"))


def check_tracklets(tracklets: DataFrame, present: DataFrame, compat: bool = False) -> DataFrame:
    """Violations (movie, rule, label, t) of a tracklet table against the labels ``present`` (movie, t, label).

    Rules: positive labels, unique labels, known parents, parents that end before their children begin, and in
    every frame the same labels in table and mask.  ``compat`` behaves as older checkers do: duplicates pass
    and the movie's last frame is not looked at.
    """
    tr = tracklets.where("t1 <= t2")
    found = [tr.where("label < 1").select("movie", F.lit("label").alias("rule"), "label", F.lit(None).cast("int").alias("t"))]
    if not compat:
        found.append(tr.groupBy("movie", "label").count().where("count > 1").select("movie", F.lit("duplicate").alias("rule"), "label", F.lit(None).cast("int").alias("t")))
    parents = tr.select("movie", F.col("label").alias("parent"), F.col("t2").alias("parent_t2"))
    child = tr.where("parent <> 0").join(parents, ["movie", "parent"], "left")
    found.append(child.where("parent_t2 is null").select("movie", F.lit("parent").alias("rule"), "label", F.lit(None).cast("int").alias("t")))
    found.append(child.where("parent_t2 >= t1").select("movie", F.lit("order").alias("rule"), "label", F.col("t1").alias("t")))
    extent = tr.groupBy("movie").agg(F.min("t1").alias("a"), (F.max("t2") - (1 if compat else 0)).alias("b"))
    inside = lambda df: df.join(extent, "movie").where("t between a and b").select("movie", "t", "label").distinct()
    table, mask = inside(_by_frame(tr)), inside(present.where("label <> 0"))
    keys = ["movie", "t", "label"]
    found.append(table.join(mask, keys, "left_anti").select("movie", F.lit("not in mask").alias("rule"), "label", "t"))
    found.append(mask.join(table, keys, "left_anti").select("movie", F.lit("not in table").alias("rule"), "label", "t"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def check_result(tracklets: DataFrame, present: DataFrame) -> DataFrame:
    """(movie, t, label) of the table that the mask lacks, in frames from the first start to before the last start."""
    extent = tracklets.groupBy("movie").agg(F.min("t1").alias("a"), F.max("t1").alias("b"))
    table = _by_frame(tracklets).join(extent, "movie").where("t >= a and t < b").select("movie", "t", "label")
    return table.join(present, ["movie", "t", "label"], "left_anti")


def label_checks(pixels: DataFrame, sequential: bool = False) -> DataFrame:
    """Per movie: least and largest label, number of labels, and whether they are valid (and 1 to max, if ``sequential``)."""
    out = pixels.groupBy("movie").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("n_labels"))
    ok: Column = F.col("least") >= 0
    return out.withColumn("valid", ok & (F.col("n_labels") == F.col("most")) if sequential else ok)


def relabel_map(pixels: DataFrame, keys: list[str], offset: int = 1) -> DataFrame:
    """keys, label, new: the non-zero labels of each group numbered from ``offset`` in ascending order."""
    if offset < 1:
        raise ValueError("offset must be positive")
    labels = pixels.where("label <> 0").select(*keys, "label").distinct()
    return numbered(labels, keys, ["label"], "new").withColumn("new", F.col("new") + (offset - 1))


def relabel_sequential(pixels: DataFrame, keys: list[str] | None = None, offset: int = 1) -> DataFrame:
    """Pixels with labels renumbered by :func:`relabel_map`; 0 stays 0."""
    keys = keys or ["movie"]
    return pixels.join(relabel_map(pixels, keys, offset), [*keys, "label"], "left").withColumn("label", F.coalesce("new", F.lit(0))).select(pixels.columns)


def points_in_box(points: DataFrame, shape: dict[str, float], origin: dict[str, float] | None = None) -> DataFrame:
    """Rows with origin <= column < origin + shape for each column named in ``shape``."""
    for c, size in shape.items():
        o = (origin or {}).get(c, 0)
        points = points.where((F.col(c) >= o) & (F.col(c) < o + size))
    return points


def crop_pixels(pixels: DataFrame, corner: dict[str, int], size: dict[str, int], frame: dict[str, int] | None = None) -> DataFrame:
    """Pixels of a box, shifted to its corner.  Without ``frame`` places outside are absent rows; with it the box is clamped to the frame."""
    low = {c: max(0, o) if frame else o for c, o in corner.items()}
    high = {c: min(frame[c], corner[c] + size[c]) if frame else corner[c] + size[c] for c in corner}
    out = points_in_box(pixels, {c: high[c] - low[c] for c in corner}, low)
    for c in corner:
        out = out.withColumn(c, F.col(c) - low[c])
    return out


def check_forward(edges: DataFrame) -> DataFrame:
    """Edges that do not point forward in time."""
    return edges.where("src.t >= dst.t")


def frame_extent(nodes: DataFrame) -> DataFrame:
    """First frame and the frame after the last, of each movie."""
    return nodes.groupBy("movie").agg(F.min("t").alias("first"), (F.max("t") + 1).alias("stop"))


def nodes_by_frame(nodes: DataFrame) -> DataFrame:
    """Sorted labels of every frame from a movie's first to its last; empty where a frame has none."""
    frames = frame_extent(nodes).select("movie", F.explode(F.sequence("first", F.col("stop") - 1)).alias("t"))
    lists = nodes.groupBy("movie", "t").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return frames.join(lists, ["movie", "t"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


def adjacent_edges(edges: DataFrame, nodes: DataFrame, incoming: bool = True) -> DataFrame:
    """Edges that end (or begin) in one of ``nodes`` (movie, t, label)."""
    side = "dst" if incoming else "src"
    keys = nodes.select("movie", F.struct("t", "label").alias(side)).distinct()
    return edges.join(keys.hint("merge"), ["movie", side], "left_semi").select(edges.columns)


def tracklets_without_truth(pixels: DataFrame) -> DataFrame:
    """Every detection as a tracklet of one frame without parent."""
    return pixels.where("label <> 0").select("movie", "label", F.col("t").alias("t1"), F.col("t").alias("t2"), F.lit(0).alias("parent")).distinct()


def detection_positions(detections: DataFrame) -> DataFrame:
    """id, t and centroid of each detection; the id is made of frame and label.  The first axis goes by the name x."""
    node = F.concat_ws("_", F.col("t").cast("string"), F.col("label").cast("string"))
    return detections.select("movie", node.alias("id"), "t", F.col("label").alias("segmentation_id"), F.col("cy").alias("x"), F.col("cx").alias("y"))


def tracklet_summary(tracklets: DataFrame) -> DataFrame:
    """Per movie: tracklets, detections they cover, and divisions (parents of exactly two)."""
    sizes = tracklets.groupBy("movie").agg(F.count(F.lit(1)).alias("n_tracklets"), F.sum(F.col("t2") - F.col("t1") + 1).alias("n_detections"))
    twins = tracklets.where("parent <> 0").groupBy("movie", "parent").count().where("count = 2").groupBy("movie").agg(F.count(F.lit(1)).alias("n_divisions"))
    return sizes.join(twins, "movie", "left").withColumn("n_divisions", F.coalesce("n_divisions", F.lit(0)))
