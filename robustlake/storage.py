"""The shared folder of a cluster: where tables that cut lineage, stores and exports of this engine go."""

from __future__ import annotations

import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where none is set and all runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, with its partitions and their order, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Folder:
    """A folder of a store that Spark reads and writes, with the few operations that commits need."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._of().getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._files.listStatus(self._of())) if self._files.exists(self._of()) else []

    def has(self, name: str) -> bool:
        return self._files.exists(self._of(name))

    def drop(self, name: str = "") -> None:
        self._files.delete(self._of(name), True)

    def rename(self, old: str, new: str) -> bool:
        """Whether ``old`` became ``new``; never over a folder that is there."""
        return not self.has(new) and self._files.rename(self._of(old), self._of(new))

    def stamp(self, names: list[str]) -> None:
        """Files were last changed in the order of ``names``, a second apart, the last of them now."""
        for age, name in enumerate(reversed(names)):
            path = self._of(name)
            self._files.setTimes(path, int(time.time() - age) * 1000, -1)

    def drop_at_end(self) -> Folder:
        self._files.deleteOnExit(self._of())
        return self


def scratch(spark: SparkSession, name: str) -> Folder:
    """A new folder below the shared one that goes when the session ends."""
    return Folder(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").drop_at_end()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for what is read or started inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
