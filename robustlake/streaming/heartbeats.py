"""Heartbeats of workers as a stream: the last beat of each, and runs that pause when beats stay away.

Beats of a run that are at most ``limit`` apart belong together. The state of a run is
the list of such spans that the watermark has not settled yet, so it is bounded by the
watermark's delay over the limit, however many beats a run has; a late beat may extend
a span or join two. A timer in event time ends a span when the watermark passes its
last beat by ``limit``: the run is paused then, until a later span begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from robustlake.storage import Folder, scratch, settings
from robustlake.streaming.live import keep_latest, latest_table

PAUSES = "run_id long, seen_from timestamp, last_seen timestamp, paused_at timestamp, beats long"
_SPANS = "spans array<struct<first:long,last:long,beats:long>>"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def joined_spans(spans: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """Spans (first, last, beats) in order, those at most ``limit`` apart as one."""
    out: list[tuple[int, int, int]] = []
    for first, last, beats in sorted(spans):
        if out and first - out[-1][1] <= limit:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + beats
        else:
            out.append((first, last, beats))
    return out


class Silence(StatefulProcessor):
    """Times in microseconds; timers in milliseconds, as Spark has them."""

    def __init__(self, limit_seconds: float):
        self._limit = int(limit_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("spans", _SPANS)

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(s) for s in self._state.get()[0]] if self._state.exists() else []

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if spans:
            self._state.update((spans,))
            self._handle.registerTimer(-(-(spans[0][1] + self._limit) // 1000))
        else:
            self._state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._held()
        for part in rows:
            spans = joined_spans([*spans, *((t, t, 1) for t in part["at"].tolist())], self._limit)
        self._keep(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self._held()
        over = [s for s in spans if s[1] + self._limit <= now]
        self._keep([s for s in spans if s[1] + self._limit > now])
        if over:
            first, last, beats = zip(*over, strict=True)
            at = lambda x: pd.to_datetime(pd.Series(x), unit="us")
            yield pd.DataFrame({"run_id": key[0], "seen_from": at(first), "last_seen": at(last), "paused_at": at([t + self._limit for t in last]), "beats": beats})

    def close(self) -> None:
        pass


def silences(beats: DataFrame, limit_seconds: float, delay: str) -> DataFrame:
    """A pause for each time that the beats (run_id, ts) of a run stay away longer than ``limit_seconds``."""
    timed = beats.select(F.col("run_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", delay).select("run_id", "ts", F.unix_micros("ts").alias("at"))
    return timed.groupBy("run_id").transformWithStateInPandas(Silence(limit_seconds), PAUSES, "append", "eventTime")


def silences_so_far(beats: DataFrame, limit_seconds: float, delay_seconds: float) -> DataFrame:
    """What ``silences`` has reported once it has read all ``beats``: the rule on a finished table."""
    at, limit = F.unix_micros(F.col("ts").cast("timestamp")), int(limit_seconds * 1_000_000)
    rows = beats.select(F.col("run_id").cast("long").alias("run_id"), at.alias("at"))
    order = Window.partitionBy("run_id").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(order) > limit, F.lit(True)).cast("int")
    spans = rows.withColumn("begins", begins).withColumn("span", F.sum("begins").over(order))
    spans = spans.groupBy("run_id", "span").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("beats"))
    mark = rows.agg((F.max("at") - int(delay_seconds * 1_000_000)).alias("mark"))  # one row
    over = spans.join(F.broadcast(mark), F.col("last") + limit <= F.col("mark"))
    times = {"seen_from": F.col("first"), "last_seen": F.col("last"), "paused_at": F.col("last") + limit}
    return over.select("run_id", *[F.timestamp_micros(t).alias(n) for n, t in times.items()], "beats")


def arriving(rows: DataFrame, arrival: Column, files: int, name: str = "arrivals") -> Folder:
    """``rows`` as a folder of files in the order in which they arrive, as a stream of one file a step reads them."""
    spark = rows.sparkSession
    folder = scratch(spark, name)
    rows.withColumn("_arrival", arrival).repartitionByRange(files, "_arrival").drop("_arrival").write.parquet(folder.path)
    folder.stamp([n for n in folder.names() if n.startswith("part-")])
    return folder


def replayed_silences(spark: SparkSession, source: Folder, schema, limit_seconds: float, delay: str) -> DataFrame:
    """All pauses that a stream over the files of ``source`` reports."""
    out = scratch(spark, "pauses")
    beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source.path)
    with settings(spark, ROCKS):
        query = silences(beats, limit_seconds, delay).writeStream.format("parquet").option("path", f"{out.path}/rows")
        query.option("checkpointLocation", f"{out.path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PAUSES).parquet(f"{out.path}/rows")


def replayed_beats(spark: SparkSession, source: Folder, schema, key: str, order: str) -> DataFrame:
    """The last beat of each worker after a stream over the files of ``source``: each batch is merged into a table by key."""
    out = scratch(spark, "beats")
    beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source.path)
    query = beats.writeStream.foreachBatch(lambda batch, number: keep_latest(batch, number, f"{out.path}/rows", key, order))
    query.option("checkpointLocation", f"{out.path}/state").trigger(availableNow=True).start().awaitTermination()
    return latest_table(spark, f"{out.path}/rows", beats.schema)
