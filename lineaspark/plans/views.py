"""The tracking tables that the queries derive from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH, FRAMES = 1024, 100, 30

#: Common table expressions by name, with the names that each builds on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pixels": ((), """SELECT event_type AS movie, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, 0 AS z, CAST(floor(value) AS INTEGER) AS y,
  CAST(json_extract(props, '$.k') AS INTEGER) AS x, CAST(user_id + 1 AS INTEGER) AS label, value, CAST(1 + event_id % 97 AS INTEGER) AS label2 FROM events"""),
    "det": (("pixels",), """SELECT movie, t, label, 0.0::DOUBLE AS cz, avg(y) AS cy, avg(x) AS cx, count(*) AS area, sqrt(4 * count(*) / pi()) AS eq_diameter, avg(value) AS int_mean, max(value) AS int_max,
  min(value) AS int_min, var_pop(x) AS i00, -covar_pop(x, y) AS i01, var_pop(y) AS i11, max(1 - least(1.0, least(y, 1023 - y, x, 99 - x) / 5.0)) AS border_dist FROM pixels WHERE label <> 0 GROUP BY ALL"""),
    "movies": (("pixels",), "SELECT movie, max(t) + 1 AS n_frames FROM pixels GROUP BY movie"),
    "tr": ((), """SELECT 'm' AS movie, label, 3 * depth AS t1, 3 * depth + 2 AS t2, label // 2 AS parent
  FROM (SELECT CAST(c_custkey + 1 AS INTEGER) AS label, CAST(floor(log2(c_custkey + 1)) AS INTEGER) AS depth FROM customer)"""),
}


def sql(final: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None, recursive: bool = False) -> str:
    """``final`` under the named expressions and all that they need."""
    known, order = CTES | (extra or {}), []

    def need(name: str) -> None:
        for x in known[name][0]:
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = ",\n".join(f"{n} AS ({known[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{final}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as pixels: the type is the movie, the day the frame, value and k are y and x, the user is the label."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("movie"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"), F.lit(0).alias("z"), F.floor("value").cast("int").alias("y"),
        F.get_json_object("props", "$.k").cast("int").alias("x"), (F.col("user_id") + 1).cast("int").alias("label"), "value", (1 + F.col("event_id") % 97).cast("int").alias("label2"),
    )


def movies(px: DataFrame) -> DataFrame:
    return px.groupBy("movie").agg((F.max("t") + 1).alias("n_frames"))


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a binary lineage: label n descends from n div 2, three frames for each generation."""
    label = (F.col("c_custkey") + 1).cast("int")
    depth = F.length(F.bin(label.cast("long"))) - 1
    c = table(spark, sf_dir, "customer")
    return c.select(F.lit("m").alias("movie"), label.alias("label"), (3 * depth).alias("t1"), (3 * depth + 2).alias("t2"), F.floor(label / 2).cast("int").alias("parent"))


def pixels_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as pixels, for the bench."""
    li = table(spark, sf_dir, "lineitem")
    months = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    return li.select(F.col("l_returnflag").alias("movie"), months.alias("t"), F.lit(0).alias("z"), F.col("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x"), (F.col("l_suppkey") + 1).cast("int").alias("label"), F.col("l_extendedprice").alias("value"))
