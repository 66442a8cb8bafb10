"""Seeded samples that are the same at any partitioning, with and without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.operators.records import numbered
from robustlake.storage import settled

#: Bits of the hash that orders a pool, and steps of the histogram that finds a threshold.
BITS, STEPS = 60, 1 << 16


def order_of(seed: int, key: Column, bits: int = BITS) -> Column:
    """A whole number below ``2 ** bits`` that orders rows at random, the same in every run with a seed."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def without_replacement(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes, ties by key: found by a threshold, not by a sort of the pool.

    Hashes are counted in steps (a partial aggregate of ``STEPS`` rows a task at most), and only rows up to the step
    that holds the n-th are ranked, some ``n`` and a ``STEPS``-th of the pool.
    """
    hashed = pool.withColumn("_hash", order_of(seed, F.col(key)))
    step = F.shiftright("_hash", BITS - 16)
    counts = settled(hashed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")))
    reach, total = -1, 0
    for row in counts.orderBy("step").collect():  # STEPS rows at most
        if total >= n:
            break
        reach, total = row["step"], total + row["n"]
    near = hashed.where(step <= reach)
    return numbered(near.withColumn("_all", F.lit(1)), "_all", ["_hash", key], "_place", width=1 << (BITS - 20)).where(F.col("_place") <= n).select(*pool.columns)


def with_replacement(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """draw (from 0) and the row that it takes: ``n`` draws, each of any row with the same chance.

    A draw is a rank: its hash modulo the number of rows. Ranks are counted in the order of the key's hashes, so a
    draw meets its row in a join on the rank.
    """
    total = pool.count()
    if not total:
        raise ValueError("nothing to draw from")
    ranked = numbered(pool.withColumns({"_hash": order_of(seed, F.col(key)), "_all": F.lit(1)}), "_all", ["_hash", key], "_place", width=1 << (BITS - 20))
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), (order_of(seed + 1, F.col("id")) % total + 1).alias("_place"))
    return draws.join(ranked, "_place").select("draw", *pool.columns)


def sampled(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """draw, row: ``n`` samples of a pool, without replacement if it has so many rows, else with."""
    if pool.count() >= n:
        own = without_replacement(pool, key, n, seed).withColumns({"_hash": order_of(seed, F.col(key)), "_all": F.lit(1)})
        placed = numbered(own, "_all", ["_hash", key], "_place", width=1 << (BITS - 20))
        return placed.select((F.col("_place") - 1).alias("draw"), *pool.columns)
    return with_replacement(pool, key, n, seed)
