"""Rounding for large tables, and columns that are found as mirrored rows."""

import random

from lineaspark.operators import scores
from lineaspark.plans import queries as q
from pyspark.sql import functions as F


def test_rounded_many(spark):
    r = random.Random(2)
    values = [r.uniform(-1, 1) * 10 ** r.randrange(-8, 6) for _ in range(300)] + [0.0, -0.0, 0.0078125, -0.0078125, -1e-9, 1e300, -1e15, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(x, x) for x in values], "a double, b double")
    assert all(str(x.a) == str(x.b) for x in q.rounded_many(q.rounded(df, "a"), "b").collect())


def test_mirrored_rows_are_columns(spark):
    r = random.Random(5)
    nodes = spark.createDataFrame([("m", r.randrange(4), k, 0.0, float(r.randrange(9)), 0.0) for k in range(25)], "movie string, t int, label int, cz double, cy double, cx double")
    make = lambda table, *carry: scores.detection_pairs(table, 3, 4.0, carry=carry).withColumn("logit", 3 - F.col("dist"))
    both = scores.carry_blocks(nodes, make(nodes), 3, "rows", F.max("logit"), "_a")
    both = scores.carry_blocks(both, make(both), 3, "columns", F.max("logit"), "_b")
    pairs = make(both, "_a", "_b").select(scores.carried("_a", 3, "mirrored").alias("a"), scores.carried("_b", 3, "columns").alias("b"))
    assert pairs.count() > 50 and not pairs.where("not a <=> b or a is null").count()
