"""Batched scorers, numbering by ranges, hulls and sampling by workers against plain versions."""

import random

import numpy as np
from lineaspark.functions.numbering import numbered
from lineaspark.operators import regions, sampling, scores
from pyspark.sql import functions as F

PIXELS = "movie string, t int, z int, y int, x int, label int, value double"


def test_score_batches(spark):
    r = random.Random(2)
    rows = [("m", t1, t, k, 0.0, r.uniform(0, 50), r.uniform(0, 50), float(k)) for t1 in range(11) for t in (t1, t1 + 1) for k in range(r.randint(1, 6))]
    wins = spark.createDataFrame(rows, "movie string, t1 int, t int, label int, cz double, cy double, cx double, size double").repartition(3)

    def make():
        calls = [0]

        def score(places, values, padding):
            calls[0] += 1
            assert places.shape[:2] == padding.shape and values.shape[2] == 1 and not padding.all(axis=1).any()
            assert (values[padding] == 0).all() and len(places) <= 4
            sizes = (~padding).sum(axis=1)
            assert (np.diff(sizes) >= 0).all()  # sorted by length
            return np.repeat(calls[0] + values[:, :, 0][:, :, None] / 1000, places.shape[1], axis=2)

        return score

    got = scores.score_batches(wins.coalesce(1), make, ("size",), batch=4, cutoff=30).collect()
    want = {(a[1], a[2], a[3], b[2], b[3]) for a in rows for b in rows if a[1] == b[1] and np.hypot(a[5] - b[5], a[6] - b[6]) <= 30}
    assert {(x.t1, x.t_i, x.l_i, x.t_j, x.l_j) for x in got} == want and len(got) == len(want)
    assert {int(x.logit) for x in got} == {1, 2, 3}  # eleven windows in three calls
    assert all(round(x.logit % 1 * 1000) == x.l_i for x in got)
    forward = scores.score_batches(wins, make, ("size",), batch=4, cutoff=30, delta_t=1).collect()
    assert {(x.t1, x.t_i, x.l_i, x.t_j, x.l_j) for x in forward} == {x for x in want if x[3] == x[1] + 1}
    assert scores.score_batches(wins.limit(0), make, ("size",)).count() == 0


def test_numbered(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice([None, r.randint(0, 300)]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, a int, b int").repartition(5)
    for size in (1000, 37):
        got = {(x.key, x.b): x.n for x in numbered(df, ["key"], [F.col("a").asc_nulls_first(), "b"], "n", size).collect()}
        for key in "ab":
            some = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
            assert [got[key, x[2]] for x in some] == list(range(1, len(some) + 1))
    assert numbered(df.limit(0), ["key"], ["b"], "n").count() == 0


def hull_count(spots):
    """Lattice points in the hull of the middles of the pixels' sides, by all pairs of corners."""
    corners = [(2 * y + a, 2 * x + b) for y, x in spots for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    n = 0
    for y in range(min(s[0] for s in spots), max(s[0] for s in spots) + 1):
        ends = []
        for v, h in corners:
            for w, g in corners:
                if v <= 2 * y <= w:
                    ends.append(h + (g - h) * (2 * y - v) / (w - v) if w > v else h)
        n += int(np.floor(max(ends) / 2 + 1e-9) - np.ceil(min(ends) / 2 - 1e-9)) + 1
    return n


def test_convex_areas(spark):
    r = random.Random(7)
    shapes = {1: {(3, 4)}, 2: {(0, k) for k in range(6)}, 3: {(k, 2) for k in range(-3, 4)}, 4: {(0, 0), (9, 5), (2, 8)}, 5: {(k, 0) for k in range(6)} | {(5, k) for k in range(6)}}
    for k in range(6, 14):
        shapes[k] = {(r.randint(-5, 12), r.randint(-4, 20)) for _ in range(r.randint(2, 30))}
    px = spark.createDataFrame([("m", 0, 0, y, x, k, 1.0) for k, s in shapes.items() for y, x in s] + [("m", 0, 0, 50, 50, 0, 1.0)], PIXELS)
    got = {x.label: x.area_convex for x in regions.convex_areas(px).collect()}
    assert got == {k: hull_count(s) for k, s in shapes.items()}
    assert got[1] == 1 and got[2] == 6 and got[3] == 7 and got[5] == 21
    det = regions.region_features(px, 100, 100).join(regions.convex_areas(px), ["movie", "t", "label"])
    f = {x.label: x.features for x in regions.scaled_features(det, det, "regionprops").collect()}
    assert {len(x) for x in f.values()} == {7}
    for k, s in shapes.items():
        y, x = np.array(sorted(s)).T.astype(float)
        low, high = np.linalg.eigvalsh([[np.var(x), -np.cov(y, x, bias=True)[0, 1]], [-np.cov(y, x, bias=True)[0, 1], np.var(y)]])
        want = [len(s) * 0.001, 1.0, np.sqrt(max(0, 1 - low / high)) if high > 1e-12 else 0, len(s) / got[k] * 0.01]
        assert np.allclose(f[k][:4], want, atol=1e-6)


def test_shards_draw_as_alone(spark):
    """Every worker's batches are those of its own windows drawn alone."""
    r = random.Random(6)
    counts = spark.createDataFrame([(m, k, r.randint(1, 30), r.randint(0, 3)) for m in "ab" for k in range(40)], "movie string, t1 int, n_objects int, n_divs int")
    got = sampling.sample_shards(counts, 3, 60, 4, 2, seed=5, by_divisions=True)
    for k in range(3):
        own = sampling.sampling_weights(sampling.shard(counts, 3).where(F.col("worker") == k).drop("worker"), by_divisions=True)
        alone = sampling.balanced_batches(sampling.sample_windows(own, 20, 5 + k), 4, 2, 20, 5 + k)
        some = got.where(F.col("worker") == k)
        assert sorted(map(tuple, some.select(alone.columns).collect())) == sorted(map(tuple, alone.collect())) and some.count() == 20
