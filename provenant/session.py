"""Session settings that operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in ``spark.checkpoint.dir``; with a local master (tests) one of our own where that is unset."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="provenant-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    fs.deleteOnExit(path)
    return path.toString()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder, so lineage is cut and lost executors don't matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Unlike a checkpoint it brings no constraints along, which double from round to round where a loop joins a table with itself."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of rules with a broadcast hint, if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
