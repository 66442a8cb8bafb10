"""Series of a stream: against a plain loop on awkward rows, and the size of the state."""

import json
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from robustlake.storage import scratch, settings
from robustlake.streaming import heartbeats as H
from robustlake.streaming import series as Z

BEGIN = datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, event_id long, value double"


def plain(rows, delay_seconds, keep, ring):
    """key, event_id -> what a loop over each key's samples in order leaves, for those that the watermark passes."""
    mark = max(r[1] for r in rows if r[1] is not None) - timedelta(seconds=delay_seconds)
    found = {}
    for key in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[0], r[1] is None, r[1] or 0))
        ema = None
        for i, (ts, event_id, value) in enumerate(own):
            if value is not None:
                ema = value if ema is None else round((ema * keep + value * (1 - keep)) * 100) / 100
            last = sorted(r[2] for r in own[max(0, i - 2) : i + 1] if r[2] is not None)
            kept = [r[2] for r in own[max(0, i + 1 - ring) : i + 1] if r[2] is not None]
            rate = None
            if i and ts > own[i - 1][0] and value is not None and own[i - 1][2] is not None:
                rate = max(0.0, (value - own[i - 1][2]) / (ts - own[i - 1][0]).total_seconds())
            if ts <= mark:
                found[key, event_id] = ema, last[len(last) // 2] if last else None, rate, sum(kept) / len(kept) if kept else None
    return found


def close(a, b):
    return a is b if a is None or b is None else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_keys_that_share_a_bucket_keep_their_own_series(spark):
    rng, rows = random.Random(5), []
    keys = [None, 0, 1, -7, 2**60 + 1, 2**60 + 2, *range(10, 30)]
    for i in range(3000):
        key = 1 if rng.random() < 0.3 else rng.choice(keys)
        at = None if rng.random() < 0.02 else BEGIN + timedelta(seconds=rng.randrange(0, 200_000), microseconds=rng.choice([0, 0, 999_999]))
        rows.append((key, at, 2**55 + i, None if rng.random() < 0.1 else round(rng.uniform(-50, 50), 2)))
    rows += [(3, BEGIN + timedelta(seconds=500), None, 4.0), (3, BEGIN + timedelta(seconds=500), 2**55 + 9999, 8.0), (3, BEGIN + timedelta(seconds=400), 9, 6.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    late = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7200).otherwise(0)
    source = H.arriving(df, F.unix_micros("ts") + late * 1_000_000, 3, "awkward")
    want = plain(rows, 10_800, 0.55, 4)
    for buckets in (1, 5):
        got = Z.replayed_series(spark, source, df.schema, "3 hours", ring=4, buckets=buckets).collect()
        assert len(got) == len(want) and {(r.key, r.event_id) for r in got} == set(want)
        for r in got:
            assert all(map(close, r[2:], want[r.key, r.event_id])), (r, want[r.key, r.event_id])


def test_state_has_a_bounded_number_of_rows_however_many_keys(spark):
    """Each key's own state costs milliseconds a batch, which at 540,000 keys came to most of the run."""
    df = spark.range(4400).select((F.col("id") % 2200).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 10).alias("ts"), F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    source, state = H.arriving(df, F.unix_micros("ts"), 2, "many-keys"), scratch(spark, "many-keys-state")
    log = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source.path)
    with settings(spark, H.ROCKS):
        query = Z.series(log, "1 hour", ring=5).writeStream.format("noop").option("checkpointLocation", state.path).trigger(availableNow=True).start()
        query.awaitTermination()
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(held) <= 1024
