"""Features, checks, files, augmentation and sampling on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineaspark.operators import augment as x
from lineaspark.operators import sampling as b
from lineaspark.operators.regions import eccentricity, keep_near_centroids, normalize_intensity, patch_and_features, patch_features, region_features, split_objects
from lineaspark.operators.scores import blockwise_reduce, parental_norm, score_windows
from lineaspark.operators.validate import check_tracklets, nodes_by_frame, relabel_sequential
from lineaspark.operators.windows import concat_detections, pad_batches, sliding_windows, window_starts
from lineaspark.sources import tables as s

PIXELS = "movie string, t int, z int, y int, x int, label int, value double"


def boxes(spark, seed=3, frames=3, n=30, ndim=2):
    r = random.Random(seed)
    rows = {}
    for label in range(1, n + 1):
        t, y, cx, z = r.randrange(frames), r.randrange(40), r.randrange(40), r.randrange(4) if ndim == 3 else 0
        for dz in range(2 if ndim == 3 else 1):
            for dy in range(3):
                for dx in range(6):
                    rows[("m", t, z + dz, y + dy, cx + dx)] = label
    return [(*k, v, v + r.random()) for k, v in rows.items()]


@pytest.mark.parametrize("ndim", [2, 3])
def test_features_equal_plain_numbers(spark, ndim):
    rows = boxes(spark, ndim=ndim)
    got = {(r.t, r.label): r for r in region_features(spark.createDataFrame(rows, PIXELS), 48, 48, ndim).collect()}
    groups = {}
    for _, t, z, y, cx, label, v in rows:
        groups.setdefault((t, label), []).append((z, y, cx, v))
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        p = np.array(g)
        c = p[:, 3 - ndim : 3]
        d = c - c.mean(axis=0)
        cov = d.T @ d / len(c)
        tensor = np.eye(ndim) * np.trace(cov) - cov
        r = got[k]
        assert r.area == len(c) and np.allclose(r.inertia, tensor.ravel()) and np.allclose([r.cy, r.cx], c[:, -2:].mean(axis=0))
        assert np.isclose(r.eq_diameter, (2 * ndim * len(c) / math.pi) ** (1 / ndim)) and np.isclose(r.int_mean, p[:, 3].mean())
        edge = min(min(q[1], 47 - q[1], q[2], 47 - q[2]) for q in p)
        assert np.isclose(r.border_dist, max(0, 1 - edge / 5))


def test_patches_and_eccentricity(spark):
    px = spark.createDataFrame(boxes(spark), PIXELS)
    det = region_features(px, 48, 48)
    patches = {(r.t, r.label): np.array(r.patch).reshape(16, 16) for r in patch_features(px, det).collect()}
    image = {(r.t, r.y, r.x): r.value for r in px.collect()}
    for d in det.collect():
        want = [[image.get((d.t, int(d.cy) - 8 + i, int(d.cx) - 8 + k), 0.0) for k in range(16)] for i in range(16)]
        assert np.array_equal(patches[d.t, d.label], want)
    assert {len(r.features) for r in patch_and_features(px, det).collect()} == {256 + 5}
    e = det.select("inertia", eccentricity(F.col("inertia")).alias("e")).collect()
    for r in e:
        low, high = np.linalg.eigvalsh(np.array(r.inertia).reshape(2, 2))
        assert np.isclose(r.e, math.sqrt(max(0, 1 - low / high)) if high > 0 else 0, atol=1e-6)


def test_normalize_and_boxes(spark):
    px = spark.createDataFrame(boxes(spark), PIXELS)
    for scope in ("movie", "frame"):
        got = normalize_intensity(px, scope).collect()
        assert len(got) == px.count()
    rows = px.where("t = 1").toPandas().value
    low, high = np.percentile(rows, [1, 99.8])
    got = normalize_intensity(px, "frame").where("t = 1").toPandas().value
    assert np.allclose(sorted(got), sorted((rows - low) / (high - low + 1e-8)))
    det = region_features(px, 48, 48).limit(2)
    near = keep_near_centroids(px, det, 9).where("value <> 0").count()
    c = [(r.t, int(r.cy), int(r.cx)) for r in det.collect()]
    assert near == sum(any(r.t == t and abs(r.y - y) <= 4 and abs(r.x - k) <= 4 for t, y, k in c) for r in px.collect())


def test_split_objects(spark):
    dots = [("m", 0, 0, 0, 0, 1, 1.0), ("m", 0, 0, 1, 1, 1, 1.0), ("m", 0, 0, 9, 9, 1, 1.0), ("m", 0, 0, 9, 10, 2, 1.0), ("m", 1, 0, 0, 0, 3, 1.0)] + [("m", 2, 0, 0, k, 4, 1.0) for k in range(20)]
    got = split_objects(spark.createDataFrame(dots, PIXELS)).collect()
    assert [(r.t, r.n_labels, r.n_parts, r.excess) for r in got] == [(0, 2, 3, 1)]


def test_check_tracklets_compat(spark):
    tr = spark.createDataFrame([("m", 1, 0, 3, 0), ("m", 1, 0, 3, 0), ("m", 2, 3, 3, 1)], "movie string, label int, t1 int, t2 int, parent int")
    mask = spark.createDataFrame([("m", t, 1) for t in range(3)], "movie string, t int, label int")
    rules = lambda compat: Counter(r.rule for r in check_tracklets(tr, mask, compat).collect())
    assert rules(False) == {"duplicate": 1, "order": 2, "not in mask": 2}
    assert rules(True) == {"order": 2}


def test_files_round_trip(spark, tmp_path):
    tr = spark.createDataFrame([("a", 2, 1, 3, 0), ("a", 1, 0, 1, 0), ("b", 5, 4, 4, 2)], "movie string, label int, t1 int, t2 int, parent int")
    s.write_tracklets(tr, f"{tmp_path}/t")
    back = s.read_tracklets(spark, f"{tmp_path}/t/*/*.csv")
    assert sorted((r.movie.split("=")[-1], r.label, r.t1, r.t2, r.parent) for r in back.collect()) == sorted(map(tuple, tr.collect()))
    edges = spark.createDataFrame([("a", (0, 1), (1, 2), 0.5, 0.25)], "movie string, src struct<t:int,label:int>, dst struct<t:int,label:int>, dist double, weight double")
    s.write_edge_table(edges, f"{tmp_path}/e")
    assert [(r.source_frame, r.source_label, r.target_frame, r.target_label, r.weight) for r in spark.read.csv(f"{tmp_path}/e", header=True, inferSchema=True).collect()] == [(0, 1, 1, 2, 0.25)]
    px = spark.createDataFrame(boxes(spark), PIXELS)
    nodes = spark.createDataFrame([("m", 0, 1, [1.0, 2.0]), ("m", 0, 2, [3.0, 1.0, 2.0])], "movie string, t int, label int, coords array<double>")
    s.write_graph(nodes, edges, px, f"{tmp_path}/g")
    assert sorted((r.x, r.y, r.z) for r in spark.read.parquet(f"{tmp_path}/g/nodes").collect() if r.z) == [(2.0, 1.0, 3.0)]
    assert spark.read.parquet(f"{tmp_path}/g/segmentation").count() == px.count()
    bad = spark.createDataFrame([("m", [1.0])], "movie string, coords array<double>")
    with pytest.raises(Exception, match="two or three"):
        s.split_coords(bad).collect()
    with pytest.raises(Exception, match="depth"):
        s.with_depth(px.withColumn("z", F.lit(1)), 2).collect()
    files = spark.createDataFrame([("m", "b.tif"), ("m", "a.tif")], "movie string, path string")
    assert {r.path: r.t for r in s.number_frames(files).collect()} == {"a.tif": 0, "b.tif": 1}


def wins(spark):
    det = region_features(spark.createDataFrame(boxes(spark, frames=5), PIXELS), 48, 48)
    return sliding_windows(det, spark.createDataFrame([("m", 5)], "movie string, n_frames int"), 3)


def test_windows(spark):
    movies = spark.createDataFrame([("m", 5), ("short", 2), ("one", 1)], "movie string, n_frames int")
    assert Counter(r.movie for r in window_starts(movies, 3).collect()) == {"m": 3, "short": 1}
    batches = pad_batches(wins(spark), 2).collect()
    for r in batches:
        assert len(r.t) == len(r.label) == len(r.cy) == len(r.padding) and sum(r.padding) == r.t.count(-1)
    assert len({len(r.t) for r in batches if r.batch == 0}) == 1
    with pytest.raises(ValueError):
        concat_detections([movies, movies.drop("n_frames")])
    px = spark.createDataFrame([("m", 0, 0, 0, 0, 7, 1.0), ("m", 0, 0, 0, 1, 3, 1.0), ("m", 2, 0, 0, 1, 0, 1.0)], PIXELS)
    assert sorted((r.x, r.label) for r in relabel_sequential(px, offset=4).collect()) == [(0, 5), (1, 0), (1, 4)]
    assert [r.labels for r in nodes_by_frame(px.where("label <> 0").unionByName(px.where("t = 2").withColumn("label", F.lit(1)))).orderBy("t").collect()] == [[3, 7], [], [1]]


def test_scores(spark):
    p = score_windows(wins(spark), F.lit(2.0) - F.col("dist") / 10, 50)
    for mode in ("softmax", "quiet_softmax", "linear", "none"):
        out = parental_norm(p, mode)
        assert out.count() == p.count() and out.where("value < 0 or value > 1").count() == 0
    sums = parental_norm(p, "softmax").where("t_j > t_i").groupBy("t1", "t_j", "l_j", "t_i").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-3 for r in sums)
    neg = p.withColumn("value", F.lit(-1.0))
    assert {r.reduced for r in blockwise_reduce(neg, how="max").collect()} == {0.0}

    def scorer(rows):
        out = rows.merge(rows, on=["movie", "t1"], suffixes=("_i", "_j")).rename(columns={"label_i": "l_i", "label_j": "l_j"})
        return out.assign(logit=0.5)[["movie", "t1", "t_i", "l_i", "t_j", "l_j", "logit"]]

    w = wins(spark).select("movie", "t1", "t", "label")
    assert score_windows(w, scorer).count() == sum(r["count"] ** 2 for r in w.groupBy("movie", "t1").count().collect())


def test_augmentation(spark):
    w = wins(spark)
    key = ["movie", "t1", "t", "label"]
    flat = lambda df: sorted(map(str, df.select(*key, "cy", "cx").collect()))
    for level in range(4):
        a = x.augment(w, level, seed=5)
        assert a.count() == w.count() and flat(a) == flat(x.augment(w.repartition(3), level, seed=5))
    both = w.join(x.random_flip(w, 2).select(*key, F.col("cy").alias("fy")), key).collect()
    assert all(abs(r.cy) == abs(r.fy) for r in both)
    turn = [[F.lit(0.0), F.lit(-2.0)], [F.lit(2.0), F.lit(0.0)]]
    for r, q in zip(w.orderBy(*key).collect(), x.affine(w, turn, F.lit(True)).orderBy(*key).collect()):
        assert (q.cy, q.cx, q.area) == (-2 * r.cx, 2 * r.cy, 4 * r.area) and np.isclose(q.eq_diameter, 2 * r.eq_diameter)
        assert np.allclose(q.inertia, 4 * np.array([r.inertia[3], -r.inertia[2], -r.inertia[1], r.inertia[0]]))
    moved = w.join(x.random_offset(w, 2, p=1.0).select(*key, F.col("cy").alias("oy")), key).collect()
    assert all(abs(r.cy - r.oy) <= 3 for r in moved) and len({round(r.cy - r.oy, 9) for r in moved}) > 5
    crop = x.random_crop(w, (10, 30), seed=1)
    assert 0 < crop.count() <= w.count()
    frames = lambda df: {r.t1: r.n for r in df.groupBy("t1").agg(F.count_distinct("t").alias("n")).collect()}
    assert frames(crop) == frames(w)
    with pytest.raises(ValueError):
        x.random_crop(w, (1, 2, 3))
    px = spark.createDataFrame(boxes(spark), PIXELS)
    assert x.intensity_scale_shift(px).where("value < 0 or value > 1").count() == 0
    assert abs(x.augment_coords(w).agg(F.avg("cy")).first()[0]) < 200


def test_sampling(spark):
    counts = spark.createDataFrame([("a", k, 10 + k, k % 3) for k in range(20)] + [("b", k, 50, 0) for k in range(5)], "movie string, t1 int, n_objects int, n_divs int")
    weighted = b.sampling_weights(counts, True, True)
    assert abs(weighted.agg(F.sum("prob")).first()[0] - 1) < 1e-6
    draws = b.sample_windows(weighted, 5000, seed=4)
    rows = draws.collect()
    assert sorted(r.draw for r in rows) == list(range(5000))
    share = Counter((r.movie, r.t1) for r in rows)
    assert all(abs(share[r.movie, r.t1] / 5000 - r.prob) < 0.02 for r in weighted.collect())
    batches = b.balanced_batches(b.sample_windows(weighted, 100, 1), 8, 3, 100, 1).collect()
    sizes = Counter((r.pool, r.batch) for r in batches)
    assert len(batches) == 100 and max(sizes.values()) == 8 and {r.pool for r in batches} == set(range(5))
    for pool in range(5):
        spans = sorted((min(g), max(g)) for g in [[r.n_objects for r in batches if (r.pool, r.batch) == k] for k in sizes if k[0] == pool])
        assert all(a[1] <= c[0] for a, c in zip(spans, spans[1:]))
    shards = b.sample_shards(counts, 2, 40, 8, 3).collect()
    assert Counter(r.worker for r in shards) == {0: 20, 1: 20}


def test_affine_in_space(spark):
    """Three axes: coordinates, volume, diameter and tensor under a drawn map, against numpy."""
    w = spark.createDataFrame([("m", 0, t, k, float(k), 2.0 + t, 3.0 * k, 5 + k, 2.0, [float(x) for x in np.eye(3).ravel() + k]) for t in range(3) for k in range(4)],
        "movie string, t1 int, t int, label int, cz double, cy double, cx double, area long, eq_diameter double, inertia array<double>")
    u = {n: w.limit(1).select(x.uniform(3, n, lo, hi)).first()[0] for n, lo, hi in
         (("angle", -180, 180), ("scale z", 0.5, 2), ("scale y", 0.5, 2), ("scale x", 0.5, 2), ("shear y", -0.1, 0.1), ("shear x", -0.1, 0.1))}
    th, a, b = np.deg2rad(u["angle"]), u["shear y"], u["shear x"]
    turn = np.array([[1, 0, 0], [0, np.cos(th), -np.sin(th)], [0, np.sin(th), np.cos(th)]])
    m = turn @ np.diag([u["scale z"], u["scale y"], u["scale x"]]) @ np.array([[1, 0, 0], [0, 1 + a * b, a], [0, b, 1]])
    got = {(r.t, r.label): r for r in x.random_affine(w, 3, 180, (0.5, 2), p=1.0, ndim=3).collect()}
    for r in w.collect():
        q = got[r.t, r.label]
        assert np.allclose([q.cz, q.cy, q.cx], m @ [r.cz, r.cy, r.cx])
        assert np.isclose(q.area, np.linalg.det(m) * r.area) and np.isclose(q.eq_diameter, np.linalg.det(m) ** (1 / 3) * r.eq_diameter)
        assert np.allclose(q.inertia, (m @ np.reshape(r.inertia, (3, 3)) @ m.T).ravel())
    turned = x.augment_coords(w, 5, shift=0, jitter=0, ndim=3).collect()
    middle = np.array(w.agg(F.avg("cz"), F.avg("cy"), F.avg("cx")).first())
    before = {(r.t, r.label): np.linalg.norm(np.array([r.cz, r.cy, r.cx]) - middle) for r in w.collect()}
    assert all(np.isclose(np.linalg.norm(np.array([r.cz, r.cy, r.cx]) - middle), before[r.t, r.label]) for r in turned)


def test_pairs_once_equal_pairs_by_window(spark):
    from lineaspark.operators.scores import detection_pairs, in_windows, parental_norm, window_pairs

    nodes = spark.createDataFrame([("m", t, k, 0.0, float(k * 7 % 40), float((k * 5 + t) % 30)) for t in range(6) for k in range(9)], "movie string, t int, label int, cz double, cy double, cx double")
    movies = nodes.groupBy("movie").agg((F.max("t") + 1).alias("n_frames"))
    wins = nodes.join(movies, "movie").withColumn("t1", F.explode(F.expr("sequence(greatest(0, t - 3), least(t, n_frames - 4))")))
    key = ("movie", "t1", "t_i", "l_i", "t_j", "l_j", "dist")
    flat = lambda df, *more: sorted(tuple(r) for r in df.select(*key, *more).collect())
    for step in (None, 1, 2):
        assert flat(in_windows(detection_pairs(nodes, 4, 12.0, step), movies, 4)) == flat(window_pairs(wins, 12.0, step))
    score = lambda df: df.withColumn("logit", 1 - F.col("dist") / 10)
    for mode in ("softmax", "quiet_softmax", "linear", "none"):
        value = F.round("value", 9).alias("value")
        once = flat(in_windows(parental_norm(score(detection_pairs(nodes, 4, 12.0)), mode), movies, 4), value)
        assert once == flat(parental_norm(score(window_pairs(wins, 12.0)), mode), value)
