"""State of runs: phases of shards rolled up to a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(current: Column, total: Column) -> Column:
    """Whole percent, half to even, between 0 and 100; 0 without a total."""
    share = F.bround(current * 100.0 / total).cast("int")
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), share))).otherwise(F.lit(0))


def lattice(status: str = "status", order: str = "ord") -> Column:
    """Status of a phase from its shards: running, then all succeeded, then failed, then the first that stopped."""
    s = F.col(status)
    stopped = F.min_by(F.when(s.isin("paused", "cancelled"), s), F.when(s.isin("paused", "cancelled"), F.col(order)))
    return (
        F.when(F.bool_or(s == "running"), "running")
        .when(F.bool_and(s == "succeeded"), "succeeded")
        .when(F.bool_or(s == "failed"), "failed")
        .otherwise(F.coalesce(stopped, F.lit("pending")))
    )


def phase_rollup(phases: DataFrame) -> DataFrame:
    """For each run and phase: summed progress and status of the latest document of each shard."""
    held = F.struct("status", "current", "total", "ord")
    last = phases.groupBy("run_id", "phase", "shard_id").agg(F.max_by(held, "ord").alias("r")).select("run_id", "phase", "shard_id", "r.*")
    return last.groupBy("run_id", "phase").agg(
        F.sum("current").alias("current"),
        F.sum("total").alias("total"),
        percent(F.sum("current"), F.sum("total")).alias("percent"),
        lattice().alias("status"),
        F.count(F.lit(1)).alias("shards"),
    )


def overall(rolled: DataFrame, phases: int) -> DataFrame:
    """Progress of a run: mean over its phases of 1 (succeeded), percent (running) or 0, in whole percent."""
    part = F.when(F.col("status") == "succeeded", 1.0).when(F.col("status") == "running", F.col("percent") / 100.0).otherwise(0.0)
    return rolled.groupBy("run_id").agg(F.bround(F.sum(part) / phases * 100).cast("int").alias("progress"))


def current_phase(rolled: DataFrame) -> DataFrame:
    """The first running phase, or else the last that is not pending."""
    running, seen = F.col("status") == "running", F.col("status") != "pending"
    return rolled.groupBy("run_id").agg(F.coalesce(F.min(F.when(running, F.col("phase"))), F.max(F.when(seen, F.col("phase"))), F.lit(1)).alias("phase"))
