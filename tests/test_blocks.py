"""Block sums that detections carry, against windows over the pairs; model calls of bounded size."""

import random

import numpy as np
from lineaspark.operators import scores
from pyspark.sql import functions as F

NODE = "movie string, t int, label int, cz double, cy double, cx double"


def nodes(spark, n=40):
    r = random.Random(8)
    rows = [("m", r.randrange(5), k, 0.0, float(r.randrange(12)), float(r.randrange(12))) for k in range(n)]
    return spark.createDataFrame(rows + [("n", 0, 1, 0.0, 0.0, 0.0), ("n", 1, 1, 0.0, 3.0, 4.0)], NODE)


def make(table, *carry):
    pairs = scores.detection_pairs(table, 3, 5.0, crowd=3, carry=carry)
    return pairs.withColumns({"logit": 30 * (4 - F.col("dist")), "truth": ((F.col("l_i") + F.col("l_j")) % 3 == 0).cast("int")})


def rows(df, value):
    return sorted((x.movie, x.t_i, x.l_i, x.t_j, x.l_j, round(x[value], 9)) for x in df.collect())


def test_carried_norms(spark):
    table = nodes(spark)
    for mode in ("linear", "quiet_softmax"):
        got = scores.normed_pairs(table, make, 3, mode)
        assert rows(got, "value") == rows(scores.parental_norm(make(table), mode), "value")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "windowexpression" not in plan  # no pair is shuffled or sorted


def test_detection_loss(spark):
    table = nodes(spark)
    movies = spark.createDataFrame([("m", 5), ("n", 3)], "movie string, n_frames int")
    forward = lambda t, *carry: make(t, *carry).where("t_j > t_i")
    want = scores.association_loss(scores.parental_norm(scores.in_windows(make(table), movies, 3)))
    got = scores.detection_loss(table, movies, forward, 3)
    assert {x.movie: round(x.loss, 9) for x in got.collect()} == {x.movie: round(x.loss, 9) for x in want.collect()}


def test_calls_are_bounded():
    import pyarrow as pa

    seen = []

    def model():
        def score(places, values, padding):
            seen.append(padding.shape)
            return np.zeros((*padding.shape, padding.shape[1]))

        return score

    one = lambda k: {"t": k % 2, "label": k, "cz": 0.0, "cy": float(k), "cx": 0.0, "f": []}
    d = pa.array([[one(k) for k in range(n)] for n in (2, 3, 9, 10, 30)], pa.list_(pa.struct([("t", pa.int32()), ("label", pa.int32()), ("cz", pa.float64()), ("cy", pa.float64()), ("cx", pa.float64()), ("f", pa.list_(pa.float64()))])))
    batch = pa.RecordBatch.from_arrays([pa.array(["m"] * 5), pa.array(range(5), pa.int32()), d], names=["movie", "t1", "d"])
    out = list(scores._scored(model, 16, 1.0, None, 0, 200)(iter([batch])))
    assert seen == [(2, 3), (2, 10), (1, 30)] and sum(len(x) for x in out) == sum(3 * n - 2 for n in (2, 3, 9, 10, 30))


def test_logits_of_a_window_come_in_blocks(monkeypatch):
    """A window of many detections: no block of logits is larger than allowed, and all pairs come out once."""
    import pyarrow as pa

    monkeypatch.setattr(scores, "BLOCK", 50)
    monkeypatch.setattr(scores, "ROWS", 7)
    seen = []

    def model():
        def score(places, values, padding):
            def block(rows, columns):
                seen.append(len(places) * (rows.stop - rows.start) * (columns.stop - columns.start))
                return 100 * places[:, rows, None, 2] + places[:, None, columns, 2]

            return block

        return score

    one = lambda k, n: {"t": 3 * k // n, "label": k, "cz": 0.0, "cy": float(k), "cx": 0.0, "f": []}
    kind = pa.list_(pa.struct([("t", pa.int32()), ("label", pa.int32()), ("cz", pa.float64()), ("cy", pa.float64()), ("cx", pa.float64()), ("f", pa.list_(pa.float64()))]))
    sizes = (2, 5, 40)
    batch = pa.RecordBatch.from_arrays([pa.array(["m"] * 3), pa.array(range(3), pa.int32()), pa.array([[one(k, n) for k in range(n)] for n in sizes], kind)], names=["movie", "t1", "d"])
    for delta in (None, 1, 2):
        out = [x for b in scores._scored(model, 2, 9.0, delta, 0, 10**9)(iter([batch])) for x in b.to_pylist()]
        steps = range(-3, 4) if delta is None else range(1, delta + 1)
        want = {(w, i, j) for w, n in enumerate(sizes) for i in range(n) for j in range(n) if abs(i - j) <= 9 and 3 * j // n - 3 * i // n in steps}
        assert len(out) == len(want) and {(x["t1"], x["l_i"], x["l_j"]) for x in out} == want
        assert all(x["logit"] == 100 * x["l_i"] + x["l_j"] for x in out)
    assert max(seen) <= 50
