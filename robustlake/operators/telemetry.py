"""Series operators: smoothing, medians, rates and rings, each within its own key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from robustlake.operators.ranges import windowed
from robustlake.operators.runstate import Machine, replay


def smoothed(series: DataFrame, key: str, order: list[str], value: str, keep: float = 0.55, digits: int = 2, jump: float | None = None) -> DataFrame:
    """Exponential moving average, rounded at each step; a null keeps the previous value. One row per sample.

    With ``jump``, a value further than that from the average starts it anew. Samples of a key come sorted to one
    task, which carries one average from row to row and batch to batch, whatever the number of samples.
    """
    rows = series.select(key, *order, F.col(value).cast("double").alias("ema"))
    dealt = rows.repartition(key).sortWithinPartitions(key, *order, "ema")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, started, scale = None, None, False, float(10**digits)
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                # NaN keys are one group for Spark
                if not started or (k != own and not (k != k and own != own)):
                    own, at, started = k, None, True
                if v is not None:
                    # NaN is above every number for Spark
                    if at is None or (jump is not None and not abs(v - at) <= jump):
                        at = v
                    else:
                        x = (at * keep + v * (1 - keep)) * scale
                        at = (round(x) if math.isfinite(x) else x) / scale  # half to even
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], schema=batch.schema)

    return dealt.mapInArrow(work, dealt.schema)


def rolling_median(series: DataFrame, key: str, order: list[str], value: str, size: int = 3) -> DataFrame:
    """Median of the last ``size`` samples (the upper of two), to one place."""

    def work(rows: DataFrame, w: WindowSpec) -> DataFrame:
        held = F.sort_array(F.collect_list("_v").over(w.rowsBetween(-(size - 1), 0)))
        return rows.withColumn("median", F.round(F.element_at(held, (F.size(held) / 2).cast("int") + 1), 1))

    rows = series.select(key, *order, F.col(value).alias("_v"))
    return windowed(rows, key, order, size - 1, work).select(key, *order, "median")


def _with_previous(names: list[str]):
    """Columns ``p_`` of the sample before."""
    return lambda rows, w: rows.withColumns({f"p_{n}": F.lag(n).over(w) for n in names})


def rates(series: DataFrame, key: str, order: list[str], counter: str, seconds: Column) -> DataFrame:
    """Increase of a counter per second, never negative; null for the first sample and without time between."""
    rows = series.select(key, *order, F.col(counter).alias("c"), seconds.alias("s"))
    rows = windowed(rows, key, order, 1, _with_previous(["c", "s"]))
    gap = F.col("s") - F.col("p_s")
    return rows.select(key, *order, F.when(gap > 0, F.greatest(F.lit(0.0), (F.col("c") - F.col("p_c")) / gap)).alias("rate"))


#: Whether an energy counter has a baseline: a reset drops it, the next sample is the new one.
BASELINE = Machine(["none", "held"], {("none", "sample"): "held", ("held", "sample"): "held", ("none", "drop"): "held", ("held", "drop"): "none"})


def power(series: DataFrame, key: str, order: list[str], counter: str, seconds: Column) -> DataFrame:
    """Watts from an energy counter in microjoules; a reset gives null and drops its own sample as a baseline.

    The sample after a reset is a first one, even if the counter fell again.
    """
    rows = series.select(key, *order, F.col(counter).alias("c"), seconds.alias("s"))
    rows = windowed(rows, key, order, 1, _with_previous(["c", "s"]))
    fell = F.coalesce((F.col("s") > F.col("p_s")) & (F.col("c") < F.col("p_c")), F.lit(False))
    rows = replay(rows.withColumn("fell", fell), key, order, F.when(fell, "drop").otherwise("sample"), BASELINE)
    good = (F.col("before") == "held") & ~F.col("fell") & (F.col("s") > F.col("p_s"))
    return rows.select(key, *order, F.when(good, (F.col("c") - F.col("p_c")) / (F.col("s") - F.col("p_s")) / 1e6).alias("watts"))


def cpu_percent(series: DataFrame, key: str, order: list[str], total: str, idle: str) -> DataFrame:
    """Busy share of the time between two samples of cumulative counters, 0 to 100; null for the first and without time between."""
    rows = series.select(key, *order, F.col(total).alias("t"), F.col(idle).alias("i"))
    rows = windowed(rows, key, order, 1, _with_previous(["t", "i"]))
    gap = F.col("t") - F.col("p_t")
    busy = (1 - (F.col("i") - F.col("p_i")) / gap) * 100
    return rows.select(key, *order, F.when(gap > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), busy)), 2)).alias("percent"))


def ring(series: DataFrame, key: str, order: list[str], size: int = 720) -> DataFrame:
    """The last ``size`` samples of each key."""
    back = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return series.select("*", F.row_number().over(back).alias("age")).where(F.col("age") <= size)


def gauge(percent: Column) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))
    return F.when(p.isNull(), "unknown").when(p >= 90, "danger").when(p >= 75, "warn").otherwise("ok")


def fresh(last_seen: Column, now: Column, poll_seconds: float) -> Column:
    """Whether a worker was seen within max(30 s, 5 polls)."""
    return now.cast("timestamp").cast("double") - last_seen.cast("timestamp").cast("double") <= max(30.0, 5 * poll_seconds)
