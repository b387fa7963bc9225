"""Joins of boxes in crowded places against plain loops, and the size of their keys."""

import random

import pytest
from lineaspark.functions import crowds
from lineaspark.functions.crowds import around, meet, placed, point
from lineaspark.operators import candidates, matching, scores
from pyspark.sql import functions as F

BOX = "movie string, t int, label int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int"
NODE = "movie string, t int, label int, cz double, cy double, cx double"


def boxes(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        y, x = (r.randrange(0, 8), r.randrange(0, 8)) if k % 3 == 0 else (r.randrange(-200, 200), r.randrange(-200, 200))
        rows.append(("m", k % 2, k, 0, 1, y, y + r.choice([1, 2, 90]), x, x + r.choice([1, 3, 70])))
    return rows + [("m", 0, n + k, 0, 1, 64, 65, 64, 65) for k in range(30)]


@pytest.mark.parametrize("crowd", [4, 20, 10_000])
def test_box_overlap(spark, crowd):
    a, b = boxes(1, 150), boxes(2, 150)
    want = sorted((x[1], x[2], y[2]) for x in a for y in b if x[1] == y[1] and x[5] <= y[6] and y[5] <= x[6] and x[7] <= y[8] and y[7] <= x[8])
    got = matching.bbox_overlap(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), crowd=crowd)
    assert sorted(map(tuple, got.select("t", "la", "lb").collect())) == want


def nodes(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        y, x = (r.random() * 3, r.random() * 3) if k % 3 == 0 else (r.randrange(-40, 40) * 1.0, r.randrange(-40, 40) * 1.0)
        rows.append(("m", k % 3, k, float(k % 2), y, x))
    rows += [("m", 1, n + k, 0.0, 5.0, 5.0) for k in range(25)]
    return rows + [("m", 1, n + 100, None, 1.0, 1.0), ("m", 1, n + 101, 0.0, None, 1.0), (None, 1, n + 102, 0.0, 1.0, 1.0), ("m", 2, n + 103, 0.0, float("nan"), 1.0)]


@pytest.mark.parametrize("crowd, ndim", [(3, 2), (10, 3), (10_000, 2)])
def test_candidates(spark, crowd, ndim):
    rows = nodes(3, 200)
    good = [x for x in rows if None not in x and x[4] == x[4]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) ** 0.5
    want = sorted((a[1], a[2], b[1], b[2]) for a in good for b in good if 0 < b[1] - a[1] <= 2 and far(a, b) <= 5)
    got = candidates.candidate_pairs(spark.createDataFrame(rows, NODE), 2, 5.0, ndim, crowd)
    assert sorted(map(tuple, got.select("src.t", "src.label", "dst.t", "dst.label").collect())) == want


@pytest.mark.parametrize("crowd", [3, 10_000])
def test_window_and_detection_pairs(spark, crowd):
    rows = [x for x in nodes(4, 120) if None not in x and x[4] == x[4]]
    df = spark.createDataFrame(rows, NODE)
    near = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])) ** 0.5 <= 4
    want = sorted((a[1], a[2], b[1], b[2]) for a in rows for b in rows if near(a, b))
    got = scores.window_pairs(df.withColumn("t1", F.lit(0)), 4, crowd=crowd).select("t_i", "l_i", "t_j", "l_j")
    assert sorted(map(tuple, got.collect())) == want
    got = scores.detection_pairs(df, 2, 4, crowd=crowd).select("t_i", "l_i", "t_j", "l_j")
    assert sorted(map(tuple, got.collect())) == [x for x in want if abs(x[0] - x[2]) < 2]


def test_no_key_is_crowded(spark):
    """A third of all detections in one place and another third about it: keys stay small, and no pair is lost."""
    n, crowd = 3000, 50
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000
    at = lambda k: F.when(F.col("id") % 3 == 0, F.lit(7.0)).when(F.col("id") % 3 == 1, 5 + 4 * u(k)).otherwise(1000 * u(k))
    some = spark.range(n).select(F.lit("m").alias("movie"), "id", at(1).alias("y"), at(2).alias("x"))
    a, b = (some.select("movie", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "y", "x")]) for s in "ij")
    reach = [around("y_i", 16), around("x_i", 16)], [point("y_j"), point("x_j")]
    left, right, on = placed(a, b, ["movie"], *reach, 16.0, crowd)
    for side in (left, right):
        assert side.groupBy(*on).count().agg(F.max("count")).first()[0] <= 2 * crowd
    boxes_ = F.greatest(F.abs(F.col("y_i") - F.col("y_j")), F.abs(F.col("x_i") - F.col("x_j"))) <= 16
    assert meet(a, b, ["movie"], *reach, 16.0, crowd).where(boxes_).count() == a.join(b, "movie").where(boxes_).count()


def test_empty(spark):
    none = spark.createDataFrame([], NODE)
    assert candidates.candidate_pairs(none, 1, 5.0).count() == 0 and matching.centroid_score(none, none).count() == 0


def test_few_boxes_meet_without_cells(spark, monkeypatch):
    """Frames with few boxes on one side: the same pairs as by cells, and the other side's boxes are neither listed nor shuffled."""
    r = random.Random(3)
    kind = "movie string, t int, label int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int"
    box = lambda label, size: ("m", r.randrange(3), label, 0, 1, *[e for low in (r.randrange(200), r.randrange(200)) for e in (low, low + r.randint(1, size))])
    a, b = spark.createDataFrame([box(k, 20) for k in range(300)], kind), spark.createDataFrame([box(k, 150) for k in range(30)], kind)
    few = matching.bbox_overlap(a, b)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "strategy=broadcast" in plan
    monkeypatch.setattr(matching, "NARROW", 3)
    cells = matching.bbox_overlap(a, b)
    assert "Generate" in cells._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((x.t, x.la, x.lb, round(x.overlap, 9)) for x in df.collect())
    assert rows(few) == rows(cells) and few.count() > 300


def test_few_centroids_meet_without_cuts(spark, monkeypatch):
    """One side with few centroids: the same scores as by cut and sliced cells, and no cell is counted, cut or sliced."""
    good = lambda seed, n: spark.createDataFrame([x for x in nodes(seed, n) if None not in x and x[4] == x[4]], NODE)
    a, b = good(5, 200), good(6, 60)
    score = lambda: sorted((x.t, x.la, x.lb, round(x.score, 9)) for x in matching.centroid_score(a, b, 6, crowd=5).collect())

    def none(*_):
        raise AssertionError("cells are counted")

    with monkeypatch.context() as m:
        m.setattr(crowds, "placed", none)
        few = score()
    monkeypatch.setattr(matching, "_FEW", 0)
    assert few == score() and len(few) > 300
