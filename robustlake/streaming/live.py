"""Structured Streaming twins of the batch operators: logs read as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from robustlake.operators.records import latest


def record_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """An append-only Parquet log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stage_windows(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and mean times of stages in event-time windows; late records count until the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


#: Parts of a table kept by ``keep_latest``; a batch rewrites those that its keys fall into.
BUCKETS = 16


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(batch id, folder) of the complete manifests below ``path``, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("manifest-")]
    return sorted((int(p.getName().split("-")[1]), p.toString()) for p in found if files.exists(hadoop.Path(p, "_SUCCESS")))


def _folders(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket -> batch that last wrote it, by the newest manifest (of a batch earlier than ``before``)."""
    known = [folder for number, folder in _manifests(spark, path) if before is None or number < before]
    return {r.bucket: r.batch for r in spark.read.parquet(known[-1]).collect()} if known else {}


def latest_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``keep_latest`` keeps."""
    folders = [f"{path}/batch={batch}/bucket={bucket}" for bucket, batch in _folders(spark, path).items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def keep_latest(batch: DataFrame, batch_id: int, path: str, key: str, order: str) -> None:
    """For foreachBatch: the table at ``path`` holds the last write of each key, whatever order records come in.

    A batch writes the buckets of its keys into a folder of its own, and then a manifest that says which folder holds
    each bucket. Nothing that an earlier manifest names is changed, so a batch that is lost or comes again at any
    point starts from the state before it. Folders that only older manifests name go at the end.
    """
    spark = batch.sparkSession
    before = _folders(spark, path, batch_id)
    own = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    touched = sorted(r.bucket for r in own.select("bucket").distinct().collect())
    held = [f"{path}/batch={before[b]}/bucket={b}" for b in touched if b in before]
    rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*held)) if held else batch
    kept = latest(rows, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
    now = before | {b: batch_id for b in touched}
    spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{batch_id:012d}")
    _forget(spark, path, set(now.values()) | set(before.values()))


def _forget(spark: SparkSession, path: str, needed: set[int]) -> None:
    """Drop batches and manifests that neither the newest nor the one before it needs."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for _, folder in _manifests(spark, path)[:-2]:
        files.delete(hadoop.Path(folder), True)
    for f in files.listStatus(hadoop.Path(path)):
        name = f.getPath().getName()
        if name.startswith("batch=") and int(name.split("=")[1]) not in needed:
            files.delete(f.getPath(), True)


def smoothed_stream(events: DataFrame, keep: float = 0.55) -> DataFrame:
    """Exponential moving average of each user's values in the order of arrival, its state kept between triggers.

    ``series.series`` waits for late values and takes them in their place.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"]:
            if pd.notna(v):
                at = float(v) if at is None else round(float(at * keep + v * (1 - keep)) * 100) / 100.0
            out.append(at)
        if at is not None:
            state.update((at,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "ema": out})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ema double", "at double", "append", GroupStateTimeout.NoTimeout)


def paused_runs(heartbeats: DataFrame, runs: DataFrame, now: str, poll_seconds: float) -> DataFrame:
    """Runs marked as running whose worker was not seen within max(30 s, 5 polls): they become paused."""
    seen = heartbeats.groupBy("run_id").agg(F.max("last_seen").alias("last_seen"))
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last_seen").cast("timestamp").cast("double")
    stale = (F.col("status") == "running") & (F.col("last_seen").isNull() | (age > max(30.0, 5 * poll_seconds)))
    return runs.join(seen, "run_id", "left").select("run_id", F.when(stale, "paused").otherwise(F.col("status")).alias("status"))
