"""Candidate edges between detections of neighbouring frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crowds import CROWD, around, meet, point
from ..functions.loops import discard, materialize

_AXES = ("cz", "cy", "cx")


def _distance() -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{c}_i") - F.col(f"{c}_j"), 2) for c in _AXES), F.lit(0.0)))


def _sides(nodes: DataFrame, delta_t: int) -> tuple[DataFrame, DataFrame]:
    """Sources, once for each later frame ``t`` that they reach, and targets."""
    src = nodes.select("movie", F.col("t").alias("ti"), F.col("label").alias("li"), *[F.col(c).alias(f"{c}_i") for c in _AXES], F.explode(F.sequence(F.lit(1), F.lit(delta_t))).alias("d"))
    dst = nodes.select("movie", "t", F.col("label").alias("lj"), *[F.col(c).alias(f"{c}_j") for c in _AXES])
    return src.withColumn("t", F.col("ti") + F.col("d")).drop("d"), dst


def _edges(pairs: DataFrame) -> DataFrame:
    side = lambda t, label: F.struct(F.col(t).alias("t"), F.col(label).alias("label"))
    return pairs.select("movie", side("ti", "li").alias("src"), side("t", "lj").alias("dst"), "dist")


def candidate_pairs(nodes: DataFrame, delta_t: int = 1, max_distance: float | None = None, ndim: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (movie, src, dst, dist) from each node to those up to ``delta_t`` frames later within ``max_distance``.

    Nodes are keyed by frame and by a grid cell as wide as the distance, the later side in its own cell, the
    earlier one in all that it reaches, so that only near nodes meet; with three dimensions cells are cut in
    depth too.  Cells with more than ``crowd`` nodes are cut and sliced (:func:`meet`).  Without a distance the answer is all pairs
    of two frames; where the nearest are wanted, :func:`nearest_pairs` finds them without making these.
    """
    src, dst = _sides(nodes, delta_t)
    if max_distance is None:
        return _edges(src.join(dst, ["movie", "t"]).withColumn("dist", _distance()))
    axes = _AXES[3 - ndim :]
    pairs = meet(src, dst, ["movie", "t"], [around(f"{c}_i", max_distance) for c in axes], [point(f"{c}_j") for c in axes], max_distance, crowd)
    return _edges(pairs.withColumn("dist", _distance()).where(F.col("dist") <= max_distance))


def nearest_pairs(nodes: DataFrame, k: int, delta_t: int = 1, ndim: int = 2, max_distance: float | None = None) -> DataFrame:
    """Edges (movie, src, dst, dist) from each node to the ``k`` nearest of each of the next ``delta_t`` frames, however far or within ``max_distance``.

    Rings grow by levels of a grid: a place of sources meets the targets of its own cell and the adjacent ones, and is done when ``k`` of
    them are nearer than a cell is wide, or when a cell is wider than the movie or the distance.  Others meet cells twice as wide
    in the next round.  Cells are so small at first that few targets share one; a place still open has fewer than
    ``k`` near it, so it meets few again.  Of targets in one place only the ``k`` first labels can be among
    the nearest, and sources in one place have the same nearest, so a crowded place stays small.  Ties go to the smaller
    label.  Nodes without finite coordinates have no edges.  Tables of places are far smaller as files than in memory, so no join sends one
    through the driver.
    """
    axes = _AXES[3 - ndim :]
    nodes = nodes.select("movie", "t", "label", *_AXES)
    for c in _AXES:
        nodes = nodes.where(F.abs(c) < float("inf"))
    nodes = materialize(nodes)
    src, dst = _sides(nodes, delta_t)
    place = Window.partitionBy("movie", "t", *[f"{c}_j" for c in _AXES]).orderBy("lj")
    dst = materialize(dst.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place"))
    ends = [e for c in axes for e in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))]
    extent = nodes.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n"), *ends).groupBy("movie")
    extent = extent.agg(F.max("n").alias("most"), *[e for c in axes for e in (F.min(f"{c}_low").alias(f"{c}_low"), (F.max(f"{c}_high") - F.min(f"{c}_low")).alias(f"{c}_span"))])
    # About sixteen cells for each node of the fullest frame, were they spread evenly.
    span = F.greatest(*[F.col(f"{c}_span") for c in axes], F.lit(1e-9))
    cap = span if max_distance is None else F.least(span, F.lit(float(max_distance)))
    grid = extent.select("movie", *[f"{c}_low" for c in axes], (span / F.ceil(F.pow(16.0 * F.col("most"), 1.0 / ndim))).alias("width"), (cap * (1 + 1e-6)).alias("cap"))
    # Frames without targets have no edges.
    source = ["movie", "t", *[f"{c}_i" for c in _AXES]]
    open_ = src.select(*source).distinct().join(dst.select("movie", "t").distinct(), ["movie", "t"]).join(grid, "movie")
    for c in axes:
        open_ = open_.withColumn(f"{c}_cell", (F.col(f"{c}_i") - F.col(f"{c}_low")) / F.col("width"))
    open_ = materialize(open_.drop(*[f"{c}_low" for c in axes]))
    there = dst.join(grid, "movie")
    for c in axes:
        there = there.withColumn(f"{c}_cell", (F.col(f"{c}_j") - F.col(f"{c}_low")) / F.col("width"))
    there = materialize(there.drop("width", "cap", *[f"{c}_low" for c in axes]))
    done = None
    for level in range(64):
        size = float(2**level)
        asked = open_.select(*source, (F.col("width") * size).alias("wide"), "cap", *[F.floor(F.col(f"{c}_cell") / size).alias(f"g{c}") for c in axes])
        for c in axes:
            asked = asked.withColumn(f"g{c}", F.explode(F.array(F.col(f"g{c}") - 1, F.col(f"g{c}"), F.col(f"g{c}") + 1)))
        held = there.select("movie", "t", "lj", *[f"{c}_j" for c in _AXES], *[F.floor(F.col(f"{c}_cell") / size).alias(f"g{c}") for c in axes])
        met = asked.join(held.hint("merge"), ["movie", "t", *[f"g{c}" for c in axes]]).withColumn("dist", _distance()).select(*source, "wide", "cap", "lj", "dist")
        if max_distance is not None:
            met = met.where(F.col("dist") <= max_distance)
        by = Window.partitionBy(*source)
        met = met.withColumn("rank", F.row_number().over(by.orderBy("dist", "lj"))).where(F.col("rank") <= k)
        met = met.withColumn("far", F.max("dist").over(by)).withColumn("have", F.count(F.lit(1)).over(by))
        sure = ((F.col("have") == k) & (F.col("far") < F.col("wide"))) | (F.col("wide") >= F.col("cap"))
        found = materialize(met.where(sure).select(*source, "lj", "dist"))
        done = found if done is None else done.unionByName(found)
        before, open_ = open_, materialize(open_.where(F.col("width") * size < F.col("cap")).join(found.select(*source).distinct().hint("merge"), source, "left_anti"))
        discard(before)
        if not open_.limit(1).count():
            return _edges(src.select(*source, "ti", "li").join(done.hint("merge"), source))
    raise RuntimeError("coordinates that no grid can hold")


def scored_pairs(nodes: DataFrame, scores: DataFrame, delta_t: int = 1, max_distance: float | None = None) -> DataFrame:
    """``scores`` (movie, src, dst, weight) of nodes up to ``delta_t`` frames apart, with their distances: no other pair is made."""
    out = scores.select("movie", "src", "dst", "weight").where(F.col("dst.t") - F.col("src.t") <= delta_t).where(F.col("dst.t") > F.col("src.t"))
    for side, k in (("src", "i"), ("dst", "j")):
        out = out.join(nodes.select("movie", F.struct("t", "label").alias(side), *[F.col(c).alias(f"{c}_{k}") for c in _AXES]), ["movie", side])
    out = out.select("movie", "src", "dst", _distance().alias("dist"), "weight")
    return out.where(F.col("dist") <= max_distance) if max_distance is not None else out


def weigh_edges(pairs: DataFrame, scores: DataFrame | None = None, max_distance: float | None = None) -> DataFrame:
    """``pairs`` with a weight: the score (movie, src, dst, weight) where one is known, else none; or 1 - dist / max_distance."""
    if scores is None:
        if not max_distance:
            raise ValueError("weights from distances need max_distance")
        return pairs.withColumn("weight", 1 - F.col("dist") / F.lit(float(max_distance)))
    return pairs.join(scores.select("movie", "src", "dst", "weight"), ["movie", "src", "dst"])


def nearest_candidates(edges: DataFrame, k: int | None = 10) -> DataFrame:
    """The ``k`` nearest weighted edges of each source to each target frame; ties go to the smaller label."""
    if not k:
        return edges
    order = Window.partitionBy("movie", "src", "dst.t").orderBy("dist", "dst.label")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def build_graph(nodes: DataFrame, scores: DataFrame | None = None, use_distance: bool = False, max_distance: float | None = None, max_neighbors: int | None = None, delta_t: int = 1, ndim: int = 2) -> DataFrame:
    """Weighted candidate edges; weights are joined before the nearest are chosen, so unscored pairs take no place.

    With weights from distances and ``max_neighbors``, the nearest are searched (:func:`nearest_pairs`), so pairs that are not among them
    are not made.
    """
    if use_distance or scores is None:
        near = nearest_pairs(nodes, max_neighbors, delta_t, ndim, max_distance) if max_neighbors and max_distance else candidate_pairs(nodes, delta_t, max_distance, ndim)
        return weigh_edges(near, None, max_distance)
    return nearest_candidates(scored_pairs(nodes, scores, delta_t, max_distance), max_neighbors)
