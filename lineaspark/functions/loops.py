"""Fixpoint loops: each round is written to the shared checkpoint folder, which cuts the plan and survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only in a local session where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or f"file:///tmp/lineaspark-{uuid.uuid4().hex}")
    return named or context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; unlike a checkpoint it shows its true size to the optimizer."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that is not needed any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], DataFrame], most: int = 200) -> DataFrame:
    """Apply ``step`` until ``changed`` of a round has no row; ``most`` rounds at most, else an error."""
    now = materialize(start)
    for _ in range(most):
        if not changed(now).limit(1).count():
            return now
        before, now = now, materialize(step(now))
        discard(before)
    raise RuntimeError(f"no fixpoint after {most} rounds")
