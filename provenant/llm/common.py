"""What the operators share: staging in the cluster's shared folder, checked broadcasts, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that vectorised code takes at once, but for a longer text, whose parts it takes in turn; its temporaries are a few dozen times that.
STEP_BYTES = 1 << 19

#: Most rows of a table of small fixed-width rows (three or four longs) that is broadcast.
BROADCAST_ROWS = 200_000


class Sealed:
    """A caller's table under names of our own (in0, in1 ..), so that no column of it clashes with those an operator works with.

    ``df`` has the renamed columns but for those that the operator replaces; ``self[name]`` is a column's name there.
    """

    def __init__(self, df: DataFrame, *replaced: str):
        gone = {c.lower() for c in replaced}
        every = [f"in{i}" for i in range(len(df.columns))]
        kept = [(c, i) for c, i in zip(df.columns, every, strict=True) if c.lower() not in gone]
        self.names, self.inner = [c for c, _ in kept], [i for _, i in kept]
        self.df = df.toDF(*every).select(*self.inner)

    def __getitem__(self, name: str) -> str:
        for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
            if found := [i for c, i in zip(self.names, self.inner, strict=True) if same(c)]:
                return found[0]
        raise ValueError(f"no column {name}")

    def open(self, df: DataFrame, **added: Column) -> DataFrame:
        """The caller's columns of ``df`` by their own names, and further ones."""
        return df.select(*(F.col(i).alias(c) for c, i in zip(self.names, self.inner, strict=True)), *(c.alias(name) for name, c in added.items()))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` that gives memory back at the end of a task: workers live on, and what they keep adds up over the stages of a job."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give unused memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; with a local master (tests) one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="provenant-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/provenant-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return fs.makeQualified(target).toString()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables whose last reader is done, and let Spark drop shuffle files that nothing refers to any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(df._staged)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    if staged:
        staged[0].sparkSession.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged: counting reads metadata only) with a broadcast hint if it has few rows; else a shuffled join follows."""
    return F.broadcast(df) if df.count() <= rows else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column end to end, and the n+1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8)
    base = int(ends[0]) if len(wide) else 0
    size = int(ends[-1]) - base if len(wide) else 0
    raw = np.frombuffer(data, np.uint8, size, base) if data is not None and size else np.zeros(0, np.uint8)
    return raw, ends - base


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def single(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch by name."""
    return batch.column(batch.schema.get_field_index(name))
