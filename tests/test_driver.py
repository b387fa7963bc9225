"""Tables that grow with the detections do not go through the driver: their joins are merges, however small their files are."""

from lineaspark.operators import candidates, lineage, validate
from pyspark.sql import functions as F

SENT = "BroadcastHashJoin"
EDGE = "movie string, src struct<t:int,label:int>, dst struct<t:int,label:int>, weight double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_nodes_is_sent(spark):
    edges = spark.createDataFrame([("m", (t, 1), (t + 1, 1), 1.0) for t in range(3)], EDGE)
    pixels = spark.createDataFrame([("m", 0, 1), ("m", 2, 1), ("m", 2, 5)], "movie string, t int, label int")
    found = [lineage.node_tracklets(edges), validate.adjacent_edges(edges, pixels), lineage.apply_solution(pixels, edges.select("movie", "src.t", "src.label"), strict=False)]
    assert [df.count() for df in found] == [4, 1, 2] and not any(SENT in plan(df) for df in found)


def test_search_sends_no_place(spark, monkeypatch):
    """Neither the targets in their cells nor the places that are done go to every task."""
    seen = []
    real = candidates.materialize
    monkeypatch.setattr(candidates, "materialize", lambda df: (seen.append(plan(df)), real(df))[1])
    nodes = spark.range(60).select(F.lit("m").alias("movie"), (F.col("id") % 2).cast("int").alias("t"), F.col("id").cast("int").alias("label"), F.lit(0.0).alias("cz"), (F.col("id") % 17).cast("double").alias("cy"), (F.col("id") % 13).cast("double").alias("cx"))
    assert candidates.nearest_pairs(nodes, 2).count() == 60
    rounds = [p for p in seen if "LeftAnti" in p or "gcy" in p]
    assert rounds and not any(SENT in p for p in rounds)
