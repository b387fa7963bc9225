"""Pixel, tracklet and graph tables: reading, slicing, merging and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXELS = "movie string, t int, z int, y int, x int, label int, value double"
TRACKLETS = "label int, t1 int, t2 int, parent int"


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A pixel table; columns and filters reach the Parquet scan."""
    return spark.read.schema(PIXELS).parquet(path)


def number_frames(files: DataFrame) -> DataFrame:
    """(movie, path) of single-frame files with the frame index t, by name within each movie."""
    return files.withColumn("t", F.row_number().over(Window.partitionBy("movie").orderBy("path")) - 1)


def slice_frames(pixels: DataFrame, start: int = 0, end: int | None = None, dt: int = 1, ds: int = 1) -> DataFrame:
    """Frames ``start`` to ``end`` (exclusive), of these every ``dt``-th, counted from 0; in y and x every ``ds``-th pixel."""
    out = pixels.where((F.col("t") >= start) & ((F.col("t") - start) % dt == 0))
    if end is not None:
        out = out.where(F.col("t") < end)
    if ds > 1:
        out = out.where((F.col("y") % ds == 0) & (F.col("x") % ds == 0)).withColumn("y", F.floor(F.col("y") / ds).cast("int")).withColumn("x", F.floor(F.col("x") / ds).cast("int"))
    return out.withColumn("t", F.floor((F.col("t") - start) / dt).cast("int"))


def slice_share(pixels: DataFrame, movies: DataFrame, share: tuple[float, float]) -> DataFrame:
    """Frames from int(n * a) to int(n * b) of each movie, n being its number of frames; frames keep their index."""
    a, b = share
    if not 0 <= a < b <= 1:
        raise ValueError("share must satisfy 0 <= a < b <= 1")
    n = F.col("n_frames")
    limits = movies.select("movie", F.floor(n * F.lit(a)).alias("first"), F.floor(n * F.lit(b)).alias("stop"))
    return pixels.join(limits, "movie").where((F.col("t") >= F.col("first")) & (F.col("t") < F.col("stop"))).select(pixels.columns)


def read_tracklets(spark: SparkSession, path: str, drop_reversed: bool = True) -> DataFrame:
    """Tracklets from text files of ``label t1 t2 parent``; the movie is the name of the file's folder.

    Rows with t1 > t2 go unless ``drop_reversed`` is off.
    """
    rows = spark.read.schema(TRACKLETS).csv(path, sep=" ").select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("movie"), "label", "t1", "t2", "parent")
    return rows.where("t1 <= t2") if drop_reversed else rows


def merge_label_movies(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger label of two label movies at every pixel that either has."""
    keys = ["movie", "t", "z", "y", "x"]
    least = lambda df, name: df.groupBy(*keys).agg(F.max("label").alias(name))
    both = least(a, "la").join(least(b, "lb"), keys, "full")
    return both.select(*keys, F.greatest(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))).alias("label"))


def edge_table(edges: DataFrame) -> DataFrame:
    """source_frame, source_label, target_frame, target_label, weight of edges, sorted by movie and these four."""
    out = edges.select("movie", F.col("src.t").alias("source_frame"), F.col("src.label").alias("source_label"), F.col("dst.t").alias("target_frame"), F.col("dst.label").alias("target_label"), "weight")
    return out.orderBy("movie", "source_frame", "source_label", "target_frame", "target_label")


def write_edge_table(edges: DataFrame, path: str) -> None:
    """The edge table as CSV with a header, a folder for each movie."""
    edge_table(edges).write.partitionBy("movie").mode("overwrite").csv(path, header=True)


def write_tracklets(tracklets: DataFrame, path: str) -> None:
    """``label t1 t2 parent`` by label, without header, a folder for each movie; read by :func:`read_tracklets`."""
    out = tracklets.select("movie", "label", "t1", "t2", "parent").repartition("movie").sortWithinPartitions("movie", "label")
    out.write.partitionBy("movie").mode("overwrite").csv(path, sep=" ")


def write_masks(pixels: DataFrame, path: str) -> None:
    """A label movie as Parquet, a folder for each movie and frame; a frame is written by one task."""
    pixels.repartition("movie", "t").write.partitionBy("movie", "t").mode("overwrite").parquet(path)


def split_coords(nodes: DataFrame, coords: str = "coords") -> DataFrame:
    """An array of coordinates as columns x (last), y and, where there are three, z; other lengths are an error."""
    c = F.col(coords)
    wrong = F.assert_true(F.size(c).isin(2, 3), F.lit("coordinates must have two or three entries"))
    return nodes.where(wrong.isNull()).withColumn("z", F.try_element_at(c, F.lit(-3))).withColumn("y", F.element_at(c, -2)).withColumn("x", F.element_at(c, -1)).drop(coords)


def write_graph(nodes: DataFrame, edges: DataFrame, pixels: DataFrame, path: str) -> None:
    """Nodes (scalar coordinates), edges, segmentation and the axes' names and kinds, as tables in one folder."""
    split_coords(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    write_masks(pixels, f"{path}/segmentation")
    axes = [("t", "time"), ("z", "space"), ("y", "space"), ("x", "space")]
    nodes.sparkSession.createDataFrame(axes, "name string, kind string").write.mode("overwrite").parquet(f"{path}/axes")


def with_depth(pixels: DataFrame, ndim: int = 3) -> DataFrame:
    """Two-dimensional pixels get z = 0; asking for two dimensions of data that has a depth is an error."""
    z: Column = F.coalesce("z", F.lit(0)) if "z" in pixels.columns else F.lit(0)
    if ndim == 2:
        flat = F.assert_true(z == 0, F.lit("pixels have a depth"))
        pixels = pixels.where(flat.isNull())
    return pixels.withColumn("z", z)
