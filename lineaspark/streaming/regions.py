"""Region sums over a stream of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_regions(pixels: DataFrame) -> DataFrame:
    """Area, centroid and mean intensity of each detection, kept up to date as pixels arrive.

    For ``readStream`` input in update or complete mode.  The state is one row of sums for each detection; with
    a watermark on an event-time column among ``pixels``' grouping columns, add it before calling.
    """
    return pixels.where("label <> 0").groupBy("movie", "t", "label").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.avg("value").alias("int_mean"))
