"""Pairs found by their labels, counts made of them, and sums over places, against plain versions over all pairs."""

import random

import pytest
from lineaspark.operators import scores, windows
from lineaspark.plans import queries as q
from pyspark.sql import functions as F

NODE = "movie string, t int, label int, cz double, cy double, cx double"
FLAT = ("movie", "t_i", "l_i", "t_j", "l_j")


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [("m", t, k, 0.0, float(r.randrange(9)), float(r.randrange(9))) for t in range(9) for k in r.sample(range(1, 14), 10)]
    rows += [("n", t, 3, 0.0, 1.0, 1.0) for t in (0, 1)] + [("m", 2, 20, 0.0, None, 1.0)]
    return spark.createDataFrame(rows, NODE).localCheckpoint()


def movies(spark):
    return spark.createDataFrame([("m", 9), ("n", 2)], "movie string, n_frames int")


def test_named_pairs(spark, table):
    want = scores.detection_pairs(table, 4, 5.0).where(q._same()).select(*FLAT, F.round("dist", 9)).collect()
    got = scores.named_pairs(table, q.partners(), 4, 5.0)
    assert want and sorted(got.select(*FLAT, F.round("dist", 9)).collect()) == sorted(want)
    assert "cell_0" not in got._jdf.queryExecution().optimizedPlan().toString()  # no cell holds a crowd


def test_detection_counts(spark, table):
    wins = windows.sliding_windows(table, movies(spark), 4)
    every = scores.in_windows(scores.detection_pairs(table, 4, 5.0), movies(spark), 4).withColumn("value", q._same().cast("int"))
    want = scores.window_counts(every, wins).collect()
    got = scores.detection_counts(scores.named_pairs(table, q.partners(), 4, 5.0), wins, movies(spark), 4).select("movie", "t1", "n_objects", "n_divs")
    assert any(x.n_divs for x in want) and sorted(got.collect()) == sorted(want)
