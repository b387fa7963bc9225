"""Rings, selected percentiles, runs and intervals against plain versions."""

import itertools
import random

import pytest
from lineaspark.functions.percentiles import exact_percentiles
from lineaspark.operators import candidates, lineage, regions
from pyspark.sql import functions as F

NODE = "movie string, t int, label int, cz double, cy double, cx double"


def detections(seed, ndim):
    r = random.Random(seed)
    rows = []
    for t in range(4):
        for label in range(r.choice([1, 5, 40])):
            spread = r.choice([1, 30, 5000])  # crowds and lone ones
            rows.append(("m", t, label, r.randint(0, spread) * 0.5 if ndim == 3 else 0.0, r.randint(0, spread) * 0.5, r.randint(0, spread) * 0.5))
    rows += [("m", 1, 100 + k, 0.0, 7.0, 7.0) for k in range(30)]  # many in one place
    rows += [("n", 0, 1, 0.0, 1.0, 1.0), ("n", 1, 2, 0.0, 1.0, 1.0), ("o", 3, 1, 0.0, 0.0, 0.0)]
    return rows


@pytest.mark.parametrize("seed, ndim, k, delta", [(1, 2, 3, 2), (2, 3, 2, 1), (3, 2, 50, 1)])
def test_nearest_pairs(spark, seed, ndim, k, delta):
    rows = detections(seed, ndim)
    want = set()
    for a in rows:
        for d in range(1, delta + 1):
            near = sorted((sum((x - y) ** 2 for x, y in zip(a[3:], b[3:])) ** 0.5, b[2]) for b in rows if b[0] == a[0] and b[1] == a[1] + d)
            want |= {(a[0], a[1], a[2], a[1] + d, j, round(x, 9)) for x, j in near[:k]}
    got = candidates.nearest_pairs(spark.createDataFrame(rows, NODE), k, delta, ndim).collect()
    assert len(got) == len(want) and {(e.movie, e.src.t, e.src.label, e.dst.t, e.dst.label, round(e.dist, 9)) for e in got} == want


def test_nearest_pairs_makes_few(spark):
    """Of a crowd and an outlier every source meets a bounded number of targets."""
    nodes = spark.range(4000).select(F.lit("m").alias("movie"), (F.col("id") % 2).cast("int").alias("t"), F.col("id").cast("int").alias("label"), F.lit(0.0).alias("cz"), (F.col("id") % 50).cast("double").alias("cy"), F.floor(F.col("id") / 50).cast("double").alias("cx"))
    far = spark.createDataFrame([("m", 0, -1, 0.0, 1e6, 1e6)], NODE)
    got = candidates.nearest_pairs(nodes.unionByName(far), 2)
    assert got.count() == 2 * 2001 and got.where("dist > 1e6").count() == 2
    assert candidates.nearest_pairs(spark.createDataFrame([], NODE), 2).count() == 0


@pytest.mark.parametrize("seed, k, delta", [(5, 3, 2)])
def test_graph_searches_the_nearest(spark, monkeypatch, seed, k, delta):
    """The graph of the nearest within a distance is that of all pairs within it, which are not made; odd nodes have no edges."""
    odd = [("m", 1, 201, 0.0, None, 1.0), ("m", 1, 202, 0.0, float("nan"), 1.0), ("p", 0, 1, 0.0, 0.0, 0.0), ("p", 1, 1, 0.0, 6.0, 0.0), ("p", 1, 2, 0.0, 6.0 + 1e-6, 0.0)]
    df = spark.createDataFrame(detections(seed, 2) + odd, NODE)
    want = candidates.nearest_candidates(candidates.weigh_edges(candidates.candidate_pairs(df, delta, 6.0), None, 6.0), k)
    want = sorted(map(tuple, want.select("movie", "src", "dst", "dist", "weight").collect()))
    monkeypatch.setattr(candidates, "candidate_pairs", None)
    got = candidates.build_graph(df, use_distance=True, max_distance=6.0, max_neighbors=k, delta_t=delta)
    assert sorted(map(tuple, got.select("movie", "src", "dst", "dist", "weight").collect())) == want


def test_three_dimensions(spark):
    rows = detections(4, 3)
    df = spark.createDataFrame(rows, NODE)
    got = candidates.candidate_pairs(df, 1, 6.0, ndim=3)
    want = [(a, b) for a in rows for b in rows if a[0] == b[0] and b[1] == a[1] + 1 and sum((x - y) ** 2 for x, y in zip(a[3:], b[3:])) <= 36]
    assert got.count() == len(want)


def test_scored_graph_makes_scored_pairs_only(spark):
    nodes = spark.createDataFrame([("m", t, k, 0.0, float(k), 0.0) for t in (0, 1, 2) for k in range(5)], NODE)
    scores = spark.createDataFrame([("m", (0, 0), (1, k), 0.9) for k in range(1, 5)] + [("m", (0, 0), (2, 0), 0.9), ("m", (1, 0), (0, 0), 0.9)], "movie string, src struct<t:int,label:int>, dst struct<t:int,label:int>, weight double")
    got = candidates.build_graph(nodes, scores, max_neighbors=2)
    assert sorted((e.dst.t, e.dst.label, e.dist) for e in got.collect()) == [(1, 1, 1.0), (1, 2, 2.0)]
    assert candidates.build_graph(nodes, scores, max_distance=3, delta_t=2).count() == 4


def test_percentiles(spark):
    r = random.Random(9)
    rows = [("a", r.choice([r.uniform(-5, 5), 3.0, 1e300, -1e-300, 0.0])) for _ in range(700)] + [("b", 2.5)] * 40 + [("c", float(x)) for x in (1, 2)] + [("d", None), ("e", None), ("e", 4.0), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(3)
    at = [0.0, 0.01, 0.5, 0.998, 1.0]
    for bins in (2, 64):
        got = {x.key: x.p for x in exact_percentiles(df, ["key"], "v", at, bins=bins).collect()}
        want = {x.key: x.p for x in df.groupBy("key").agg(F.percentile("v", at).alias("p")).collect() if x.p}
        assert got == want
    with pytest.raises(Exception, match="finite"):
        exact_percentiles(spark.createDataFrame([("a", float("nan"))], "key string, v double"), ["key"], "v", [0.5]).collect()
    assert exact_percentiles(df.limit(0), ["key"], "v", at).count() == 0


def parts_of(spots):
    left, n = set(spots), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            z, y, x = todo.pop()
            for dz, dy, dx in itertools.product((-1, 0, 1), repeat=3):
                if (z + dz, y + dy, x + dx) in left:
                    left.remove((z + dz, y + dy, x + dx))
                    todo.append((z + dz, y + dy, x + dx))
    return n


def test_runs(spark):
    r = random.Random(12)
    spots = {(t, label, z, y, x) for t in range(3) for label in (1, 2, 0) for z in range(2) for y in range(7) for x in range(9) if r.random() < 0.35}
    spots |= {(3, 5, 0, 0, x) for x in range(40)}  # one long run
    rows = [("m", t, z, y, x, label, 1.0) for t, label, z, y, x in spots] * 2
    px = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, label int, value double")
    runs = regions.pixel_runs(px)
    assert runs.agg(F.sum(F.col("x1") - F.col("x0") + 1)).first()[0] == sum(s[1] != 0 for s in spots) and runs.where("t = 3").count() == 1
    got = {(x.t, x.label): x.n for x in regions.run_parts(px).groupBy("t", "label").agg(F.count_distinct("part").alias("n")).collect()}
    assert got == {k: parts_of({s[2:] for s in spots if s[:2] == k}) for k in {s[:2] for s in spots} if k[1]}
    split = {x.t: (x.n_labels, x.n_parts, x.excess) for x in regions.split_objects(px).collect()}
    assert split == {t: (2, got[t, 1] + got[t, 2], got[t, 1] + got[t, 2] - 2) for t in range(3) if got[t, 1] + got[t, 2] > 2}


def test_links_are_made_once(spark):
    """Rounds read the links from a table; movies of one plane and of several give the same parts."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows

    links = spark.createDataFrame([("m", k, k + 1) for k in range(40)], "movie string, a int, b int").mapInArrow(counted, "movie string, a int, b int")
    got = regions.component_labels(links, ["movie"]).collect()
    assert {(x.a, x.part) for x in got} == {(k, 0) for k in range(41)} and seen.value == 40
    flat = [("m", 0, 0, y, x, 1, 1.0) for y, x in ((0, 0), (1, 1), (5, 5), (7, 7))]
    kind = "movie string, t int, z int, y int, x int, label int, value double"
    split = lambda rows: [(x.t, x.n_labels, x.n_parts, x.excess) for x in regions.split_objects(spark.createDataFrame(rows, kind)).collect()]
    assert split(flat) == [(0, 1, 3, 2)] and split([*flat, ("m", 0, 1, 6, 6, 1, 1.0)]) == [(0, 1, 2, 1)] and split([]) == []


def forest(seed):
    r = random.Random(seed)
    rows = [("m", k, k, k + 1, r.choice([0, r.randint(1, max(1, k - 1))]) if k > 1 else 0) for k in range(1, 60)]
    rows += [("m", 100 + k, 0, 0, 99 + k) for k in range(40)]  # a long line below a parent that has no row
    rows += [("n", 1, 0, 3, 0), ("n", 2, 0, 3, 1), ("n", 3, 0, 3, 1)]
    return rows


def test_intervals(spark):
    rows = forest(3)
    df = spark.createDataFrame(rows, "movie string, label int, t1 int, t2 int, parent int")
    at = {(x.movie, x.label): x for x in lineage.lineage_intervals(df).collect()}
    assert set(at) == {(x[0], x[1]) for x in rows}
    up = {(m, label): (m, p) for m, label, _, _, p in rows if (m, p) in at}
    for a in at:
        line = [a]
        while line[-1] in up:
            line.append(up[line[-1]])
        above = {b for b in at if b[0] == a[0] and at[b].root == at[a].root and at[b].first <= at[a].first <= at[b].last}
        assert above == set(line) and at[a].root == line[-1][1]
    for root in {(x.movie, x.root) for x in at.values()}:
        assert sorted(x.first for x in at.values() if (x.movie, x.root) == root) == list(range(at[root].last + 1))
    assert lineage.lineage_intervals(df.limit(0)).count() == 0


def test_associations_by_intervals(spark):
    rows = forest(5)
    df = spark.createDataFrame(rows, "movie string, label int, t1 int, t2 int, parent int")
    r = random.Random(1)
    found = [(m, r.randint(0, 5), label) for m, label, *_ in rows for _ in range(2)]
    wins = spark.createDataFrame([(m, t1, t, label) for m, t, label in set(found) for t1 in range(max(0, t - 2), t + 1)], "movie string, t1 int, t int, label int")
    match = spark.createDataFrame([(m, t, label, label) for m, t, label in set(found) if label % 7], "movie string, t int, label int, truth int")
    plain = lambda x: sorted(map(tuple, x.collect()))
    got = plain(lineage.associations(wins, match, lineage.lineage_intervals(df)))
    assert got == plain(lineage.associations(wins, match, lineage.lineage_closure(df))) and len(got) == len(set(got)) > 500
