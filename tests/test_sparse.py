"""Assignments by pairs alone against the matrix kernel, and movies cut by frames."""

import numpy as np
import pytest
from lineaspark.functions import assignment
from lineaspark.operators import linking, regions
from pyspark.sql import functions as F


@pytest.mark.parametrize("share, whole", [(0.2, True), (0.5, False), (1.0, True)])
def test_pairs_alone(share, whole):
    r = np.random.default_rng(1)
    for _ in range(60):
        n, m = r.integers(1, 12, 2)
        gain = np.where(r.random((n, m)) < share, r.choice([0.25, 0.5, 1, 2, 3], (n, m)) if whole else r.random((n, m)) + 1e-3, 0)
        gain[0, 0] = 1.0
        i, j = np.nonzero(gain)
        w = gain[i, j]
        matched, surplus, price = assignment.assign_sparse(i, j, w, n, m)
        total = sum(gain[a, b] for a, b in assignment.assign(gain))
        assert len(set(i[matched])) == matched.sum() == len(set(j[matched])) and abs(w[matched].sum() - total) < 1e-9
        assert abs(surplus.sum() + price.sum() - total) < 1e-9 and (w <= surplus[i] + price[j] + 1e-9).all() and min(surplus.min(), price.min()) >= 0


def test_frames_are_not_searched(spark, monkeypatch):
    """Where all edges lead to the next frame, no components are searched and the bound is met; so too for a matrix beyond any limit."""

    def never(*_):
        raise AssertionError("components are searched")

    monkeypatch.setattr(assignment, "NARROW", 1)
    monkeypatch.setattr(assignment, "MATRIX", 4)
    edges = spark.range(120).select(F.lit("m").alias("movie"), F.struct((F.col("id") % 2).cast("int").alias("t"), F.floor(F.col("id") % 20 / 2).cast("int").alias("label")).alias("src"), F.struct((F.col("id") % 2 + 1).cast("int").alias("t"), (F.col("id") * 7 % 11).cast("int").alias("label")).alias("dst"), F.lit(1.0).alias("dist"), (F.col("id") % 9 / 10).alias("weight"))
    edges = edges.dropDuplicates(["src", "dst"]).localCheckpoint()
    searched = linking.optimal_solution(edges.unionByName(spark.createDataFrame([("n", (0, 1), (2, 1), 1.0, 0.5)], edges.schema)))["bounds"].where("movie = 'm'").first()
    monkeypatch.setattr(regions, "component_labels", never)
    found = linking.optimal_solution(edges)["bounds"].first()
    assert abs(found.cost - found.bound) < 1e-6 and abs(found.cost - searched.cost) < 1e-6
