"""Helpers that the training-data operators share.

Every operator here follows the same rules:

* a row of ``documents`` is identified by ``row_key``: its ``doc_id`` together
  with a 64-bit hash of its text, so null ids and repeated ids stay apart and
  rows that repeat both are one document with one result;
* intermediate tables are written as Parquet into the shared folder that
  ``spark.checkpoint.dir`` names, so a lost executor costs one stage at most,
  and go as soon as the operator needs them no more;
* a Python worker gives the memory of a task's batches back when the task ends;
* ids, extra columns and column names of the input never reach the operator's
  own columns: each operator selects what it needs under names of its own.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch, and bytes: a batch of the longest texts stays small.
TEXT_BATCH, BATCH_BYTES = 256, 8 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of text that Python workers receive: results are lazy, so for the session."""
    spark.conf.set(_BATCH, str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for the actions inside."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def release() -> None:
    """Hand memory that is free, but kept by the allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(work: Callable) -> Callable:
    """A function over a task's batches that releases their memory at the end."""

    @functools.wraps(work)
    def own(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return own


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-work-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the actions inside go as soon as each action ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _store(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, object, object]:
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path), files, hadoop_path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here. Kept until the session ends."""
    return _store(df, name, codec)[0]


class Scratch:
    """Intermediate tables of one operator: all go at the end of the block, or earlier by ``drop``."""

    def __init__(self):
        self._held: dict[int, tuple[DataFrame, object, object]] = {}

    def written(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        stored = _store(df, name, codec)
        self._held[id(stored[0])] = stored
        return stored[0]

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, files, path = self._held.pop(id(table))
            files.delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _, _ in list(self._held.values())])


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a document; used together with doc_id, or where a collision only costs work."""
    return F.xxhash64(doc_id, text)


def as_long(column: Column) -> Column:
    return column.cast("long")
