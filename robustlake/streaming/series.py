"""Telemetry series as a stream: smoothing, medians, rates and rings in the order of event time.

Samples wait until the watermark has passed them, so late ones take their place; then
they are settled in order, each with the state that the one before left. Keys share a
fixed number of buckets, since each call of a key's own state costs milliseconds: the
state of a bucket is the samples that wait, and for each key the average, the last
sample and a ring of the last ``ring`` values, however long the series is.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from robustlake.storage import Folder, scratch, settings
from robustlake.streaming.heartbeats import ROCKS

SETTLED = "key long, event_id long, ema double, median double, rate double, ring_mean double"

#: Parts of the keys; a checkpoint belongs to its number.
BUCKETS = 512

#: A sample as it waits; ``lacks`` has 1 for a null key and 2 for a null event_id, which are zero then.
_SAMPLE = np.dtype([("key", "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("value", "<f8"), ("lacks", "u1")])

#: Rows of a frame that a bucket yields, and of a chunk that waits again.
_ROWS = 10_000


class Series(StatefulProcessor):
    """``keep`` of the average stays at each sample; medians are of the last three values, the upper of two."""

    def __init__(self, keep: float, ring: int):
        self._keep, self._size = keep, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "samples binary")
        self._carried = handle.getValueState("carried", "keys binary")

    def _alarm(self, due: int) -> None:
        """One timer, at the earliest sample that waits."""
        timers = list(self._handle.listTimers())
        if any(t <= due for t in timers):
            return
        for timer in timers:
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            samples = np.empty(len(part), _SAMPLE)
            for name in _SAMPLE.names:
                samples[name] = part[name].to_numpy()
            self._waiting.appendValue((samples.tobytes(),))
            first = min(int(samples["at"].min()), first) if first is not None else int(samples["at"].min())
        if first is not None:
            self._alarm(-(-first // 1000))
        return iter(())

    def _step(self, at: int, value: float | None) -> tuple:
        rate = None
        if self._at is not None and at > self._at and value is not None and self._ring and self._ring[-1] is not None:
            rate = max(0.0, (value - self._ring[-1]) / ((at - self._at) / 1_000_000))
        if value is not None:
            x = value if self._ema is None else (self._ema * self._keep + value * (1 - self._keep)) * 100
            self._ema = value if self._ema is None else (round(x) if math.isfinite(x) else x) / 100  # half to even
        self._at, self._ring = at, [*self._ring, value][-self._size :]
        last = sorted(v for v in self._ring[-3:] if v is not None)
        own = [v for v in self._ring if v is not None]
        return self._ema, last[len(last) // 2] if last else None, rate, sum(own) / len(own) if own else None

    def _settled(self, ready: np.ndarray, carried: dict) -> pd.DataFrame:
        """The rows of ``ready``, which is in order; ``carried`` goes on to what they leave."""
        out, own = [], None
        for key, at, _, value, lacks in ready.tolist():
            if own != (own := (key, lacks & 1)) or not out:
                self._ema, self._at, self._ring = carried.get(own, (None, None, []))
            out.append(self._step(at, value if value == value else None))
            carried[own] = self._ema, self._at, self._ring
        numbers = dict(zip(("ema", "median", "rate", "ring_mean"), (np.array(c, dtype=float) for c in zip(*out, strict=True)), strict=True))
        whole = {n: pd.arrays.IntegerArray(ready[n].copy(), (ready["lacks"] & bit) > 0) for n, bit in (("key", 1), ("event_id", 2))}
        return pd.DataFrame(whole | numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.concatenate([np.empty(0, _SAMPLE), *(np.frombuffer(c, _SAMPLE) for (c,) in self._waiting.get())])
        later, ready = held[held["at"] > now], held[held["at"] <= now]
        del held
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if len(later):
            self._waiting.put([(later[i : i + _ROWS].tobytes(),) for i in range(0, len(later), _ROWS)])
            self._alarm(-(-int(later["at"].min()) // 1000))
        else:
            self._waiting.clear()
        if len(ready):
            ready = ready[np.lexsort((ready["event_id"], ready["lacks"] & 2, ready["at"], ready["key"], ready["lacks"] & 1))]
            carried = pickle.loads(self._carried.get()[0]) if self._carried.exists() else {}
            for i in range(0, len(ready), _ROWS):
                yield self._settled(ready[i : i + _ROWS], carried)
            self._carried.update((pickle.dumps(carried, pickle.HIGHEST_PROTOCOL),))

    def close(self) -> None:
        pass


def series(samples: DataFrame, delay: str, keep: float = 0.55, ring: int = 720, buckets: int = BUCKETS) -> DataFrame:
    """``SETTLED`` of a stream of samples (key, ts, event_id, value), once the watermark has passed them; without ts, never."""
    timed = samples.select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    lacks = F.col("key").isNull().cast("int") + F.col("event_id").isNull().cast("int") * 2
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("key", "event_id")]
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    timed = timed.where("ts IS NOT NULL").withWatermark("ts", delay).select(bucket, "ts", F.unix_micros("ts").alias("at"), *whole, "value", lacks.alias("lacks"))
    return timed.groupBy("bucket").transformWithStateInPandas(Series(keep, ring), SETTLED, "append", "eventTime")


def replayed_series(spark: SparkSession, source: Folder, schema, delay: str, keep: float = 0.55, ring: int = 720, buckets: int = BUCKETS) -> DataFrame:
    """What a stream over the files of ``source`` settles."""
    out = scratch(spark, "series")
    samples = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source.path)
    with settings(spark, ROCKS):
        query = series(samples, delay, keep, ring, buckets).writeStream.format("parquet").option("path", f"{out.path}/rows")
        query.option("checkpointLocation", f"{out.path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SETTLED).parquet(f"{out.path}/rows")
