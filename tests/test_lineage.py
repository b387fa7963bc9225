import pytest
from lineaspark.functions.loops import materialize
from lineaspark.operators.lineage import associations, identity_matching, lineage_closure, lineage_edges, lineage_intervals, linear_chains, relabel_by_tracklet, to_tracks, tracklet_table
from lineaspark.operators.linking import EDGE
from lineaspark.operators.matching import match_labels
from lineaspark.operators.regions import region_features
from lineaspark.operators.windows import sliding_windows
from lineaspark.plans.track import track
from pyspark.sql import functions as F

PIXELS = "movie string, t int, z int, y int, x int, label int, value double"
TRACKLETS = "movie string, label int, t1 int, t2 int, parent int"
#: Three frames of three pixels, and their tracklets.
TRUTH = [[0, 10, 11], [0, 10, 0], [20, 22, 0]]
TABLE = [("m", 10, 0, 1, 0), ("m", 11, 0, 0, 0), ("m", 20, 2, 2, 10), ("m", 22, 2, 2, 10)]


def movie(spark, frames):
    return spark.createDataFrame([("m", t, 0, y, 0, v, float(v)) for t, f in enumerate(frames) for y, v in enumerate(f)], PIXELS)


def test_toy_associations(spark):
    px = movie(spark, TRUTH)
    det = region_features(px, 3, 1)
    movies = spark.createDataFrame([("m", 3)], "movie string, n_frames int")
    win = sliding_windows(det, movies, 3)
    tr = spark.createDataFrame(TABLE, TRACKLETS)
    got = {(r.t_i, r.l_i, r.t_j, r.l_j) for r in associations(win, identity_matching(det), lineage_closure(tr)).collect()}
    order = [(0, 10), (0, 11), (1, 10), (2, 20), (2, 22)]
    matrix = [[int((*a, *b) in got) for b in order] for a in order]
    assert matrix == [[1, 0, 1, 1, 1], [0, 1, 0, 0, 0], [1, 0, 1, 1, 1], [1, 0, 1, 1, 0], [1, 0, 1, 0, 1]]
    seen = {(r.t, r.label): r.parent for r in lineage_edges(tr, px).collect()}
    assert seen == {(0, 10): 0, (0, 11): 0, (1, 10): 0, (2, 20): 10, (2, 22): 10}


def edges(spark, pairs):
    return spark.createDataFrame([("m", a, b, 0.0, 1.0) for a, b in pairs], EDGE)


def test_tracklets_with_division_gap_and_isolated_node(spark):
    pairs = [((0, 1), (1, 1)), ((1, 1), (2, 1)), ((2, 1), (3, 1)), ((2, 1), (3, 2)), ((3, 1), (5, 1)), ((5, 1), (6, 1)), ((3, 2), (4, 2))]
    nodes = spark.createDataFrame([("m", 2, 9)], "movie string, t int, label int")
    table, labels = tracklet_table(edges(spark, pairs), nodes)
    assert sorted((r.label, r.t1, r.t2, r.parent) for r in table.collect()) == [(1, 0, 2, 0), (2, 2, 2, 0), (3, 3, 3, 1), (4, 3, 4, 1), (5, 5, 6, 3)]
    assert {(r.t, r.label): r.tracklet for r in labels.collect()}[(6, 1)] == 5
    with pytest.raises(Exception, match="two children"):
        tracklet_table(edges(spark, [((0, 1), (1, k)) for k in (1, 2, 3)]))[0].collect()


def test_chains_share_branching_nodes(spark):
    pairs = [((0, 1), (1, 1)), ((1, 1), (2, 1)), ((1, 1), (2, 2)), ((2, 2), (4, 2))]
    nodes = spark.createDataFrame([("m", 0, 7)], "movie string, t int, label int")
    chains = {}
    for r in linear_chains(edges(spark, pairs), nodes).collect():
        chains.setdefault(r.chain, []).append(tuple(r.node))
    assert sorted(sorted(c) for c in chains.values()) == [[(0, 1), (1, 1)], [(0, 7)], [(1, 1), (2, 1)], [(1, 1), (2, 2), (4, 2)]]
    every = spark.createDataFrame([("m", *n, 0.0, 1.0, 2.0) for n in {x for p in pairs for x in p} | {(0, 7)}], "movie string, t int, label int, cz double, cy double, cx double")
    points, parents = to_tracks(edges(spark, pairs), every)
    assert points.count() == 6 and sorted((r.track_id, r.parent_id) for r in parents.collect()) == [(3, 1), (4, 1)]


@pytest.mark.parametrize("mode", ["greedy", "greedy_nodiv", "optimal"])
def test_empty_frames_and_movies(spark, mode):
    frames = [("m", 0, 0, y, x, 1, 1.0) for y in range(5, 10) for x in range(5, 10)] + [("m", 2, 0, y, x, 2, 1.0) for y in range(80, 85) for x in range(80, 85)]
    px = spark.createDataFrame(frames, PIXELS)
    movies = spark.createDataFrame([("m", 3)], "movie string, n_frames int")
    out = track(px, movies, 100, 100, mode=mode)
    assert out["tracklets"].count() == (2 if mode == "optimal" else 0)
    assert out["masks"].count() == (50 if mode == "optimal" else 0)
    none = track(px.limit(0), movies, 100, 100, mode=mode)
    assert none["tracklets"].count() == 0 and none["masks"].count() == 0 and none["edges"].count() == 0


def test_relabel_needs_pixels(spark):
    labels = spark.createDataFrame([("m", 0, 99, 1)], "movie string, t int, label int, tracklet int")
    with pytest.raises(ValueError):
        relabel_by_tracklet(movie(spark, TRUTH), labels)


def test_rolled_grid_matches(spark):
    grid = {(16 * i, 16 * k): 8 * i + k for i in range(8) for k in range(8)}
    pixel = lambda y, x, v: ("m", 0, 0, y, x, v, 1.0)
    truth = spark.createDataFrame([pixel(*p, v) for p, v in grid.items()], PIXELS)
    for roll in (0, 5):
        result = spark.createDataFrame([pixel(y, x + roll, v + 1 if v else 0) for (y, x), v in grid.items()], PIXELS)
        got = match_labels(truth, result, region_features(truth, 128, 128), region_features(result, 128, 128))
        assert sorted((r.la, r.lb) for r in got.collect()) == [(k, k + 1) for k in range(1, 64)]
    assert match_labels(truth, truth.limit(0), region_features(truth, 128, 128), region_features(truth.limit(0), 128, 128)).count() == 0


def test_intervals_send_no_table_through_the_driver(spark):
    """Tables that are small as files are not broadcast, since they are large in memory."""
    rows = [("m", k, 3 * k.bit_length(), 3 * k.bit_length() + 2, k // 2) for k in range(1, 200)]
    tr = materialize(spark.createDataFrame(rows, "movie string, label int, t1 int, t2 int, parent int"))
    found = tr.select("movie", "label", F.explode(F.sequence("t1", "t2")).alias("t"))
    wins = found.withColumn("t1", F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") - 3), F.col("t"))))
    out = associations(wins, identity_matching(found), lineage_intervals(tr))
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 8  # two tables of roots in four branches
    by_rows = associations(wins, identity_matching(found), lineage_closure(tr))
    assert out.count() == by_rows.count() and not out.exceptAll(by_rows).count()
