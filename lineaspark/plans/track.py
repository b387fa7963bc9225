"""From pixels to tracks, for many movies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import build_graph
from ..operators.lineage import apply_solution, tracklet_table
from ..operators.linking import link_greedy, link_optimal
from ..operators.regions import region_features
from ..operators.scores import average_over_windows, parental_norm, score_mask, score_windows
from ..operators.windows import sliding_windows


def pair_scores(detections: DataFrame, movies: DataFrame, scorer: Column, window: int = 4, cutoff: float = 256, delta_t: int = 1, mode: str = "quiet_softmax", threshold: float = 0.05) -> DataFrame:
    """(movie, src, dst, weight): normalised scores of forward pairs, averaged over the windows in which they pass.

    Pairs farther than ``delta_t`` apart cannot change the others' normalisation, so they are never made.
    """
    pairs = score_windows(sliding_windows(detections, movies, window), scorer, cutoff, delta_t)
    kept = score_mask(parental_norm(pairs, mode, forward_only=True), delta_t, threshold)
    mean = average_over_windows(kept, window)
    return mean.select("movie", F.struct(F.col("t_i").alias("t"), F.col("l_i").alias("label")).alias("src"), F.struct(F.col("t_j").alias("t"), F.col("l_j").alias("label")).alias("dst"), F.col("value").alias("weight"))


def track(
    pixels: DataFrame, movies: DataFrame, height: int, width: int, mode: str = "greedy", scorer: Column | None = None, use_distance: bool = False, max_distance: float = 256,
    max_neighbors: int | None = 10, delta_t: int = 1, edge_threshold: float = 0.05, window: int = 4, threshold: float = 0.5,
) -> dict[str, DataFrame]:
    """edges, tracklets, node_labels and masks of every movie; modes are greedy, greedy_nodiv and optimal.

    Greedy solutions leave out detections without a link, optimal ones keep them.  Empty movies give empty
    tables.
    """
    nodes = region_features(pixels, height, width)
    scores = None if use_distance else pair_scores(nodes, movies, scorer if scorer is not None else 1 - F.col("dist") / max_distance, window, max_distance, delta_t, threshold=edge_threshold)
    graph = build_graph(nodes, scores, use_distance, max_distance, max_neighbors, delta_t)
    if mode in ("greedy", "greedy_nodiv"):
        edges, extra = link_greedy(graph, mode == "greedy", threshold), None
    elif mode == "optimal":
        edges, extra = link_optimal(graph), nodes
    else:
        raise ValueError(f"unknown mode {mode}")
    table, labels = tracklet_table(edges, extra)
    return {"edges": edges, "tracklets": table, "node_labels": labels, "masks": apply_solution(pixels, labels, strict=False)}
