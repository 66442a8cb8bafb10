"""Operators on append-only record tables: compaction, resume, set logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(records: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last record of each key; ``order`` must be unique within a key. A partial maximum, not a sort."""
    order = F.col(order) if isinstance(order, str) else order
    held = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(key).agg(F.max_by(held, order).alias("r")).select("r.*")


def compacted(records: DataFrame, key: str, order: str) -> DataFrame:
    """Last write of each key with ``first_seen``, the order of its first one; records without a key all stay."""
    held = F.struct(*[F.col(c) for c in records.columns])
    keyed = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(held, F.col(order)).alias("r"), F.min(order).alias("first_seen"))
    loose = records.where(F.col(key).isNull()).select(held.alias("r"), F.lit(None).cast(dict(records.dtypes)[order]).alias("first_seen"))
    return keyed.select("r.*", "first_seen").unionByName(loose.select("r.*", "first_seen"))


def pending(plan: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """Cells of the plan whose latest record is not a success: what a resumed run still has to do."""
    done = latest(records, key, order).where(F.col("status") == "succeeded").select(key)
    return plan.join(done, key, "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (which must be unique)."""
    held = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(held, F.struct(*order)).alias("r")).select("r.*")


def pool_beside(full: DataFrame, compact: DataFrame) -> DataFrame:
    """Rows of ``full`` that are not in ``compact``; all of ``full`` if none is left."""
    rest = full.join(compact, full.columns, "left_anti")
    none = rest.agg((F.count(F.lit(1)) == 0).alias("none"))  # one row
    return rest.unionByName(full.join(F.broadcast(none.where("none")), how="cross").select(*full.columns))


def reconciled(ready: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """What is ready but not marked (added), or marked but not ready (removed)."""
    a, b = ready.select(key).distinct().withColumn("ready", F.lit(True)), marked.select(key).distinct().withColumn("marked", F.lit(True))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("marked").isNull(), "added").when(F.col("ready").isNull(), "removed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def reuse(requested: DataFrame, cached: DataFrame, group: str, key: str) -> DataFrame:
    """For each group: requested samples that the cache has, and those still to make."""
    have = cached.select(group, key).distinct().withColumn("have", F.lit(1))
    joined = requested.select(group, key).distinct().join(have, [group, key], "left")
    return joined.groupBy(group).agg(F.count("have").alias("reused"), (F.count(F.lit(1)) - F.count("have")).alias("pending"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "place", width: int = 65_536) -> DataFrame:
    """``rows`` with their place (from 1) in their group. The first column of ``order`` is a whole number.

    Places are counted in ranges of ``width`` of that number; the ranges' own sums tell where each begins, so a group
    of any size is shared by many tasks.
    """
    spot = F.floor(F.col(order[0]) / width)
    own = rows.select("*", F.col(group).alias("_g"), spot.alias("_s"))
    counts = own.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_g").orderBy("_s")) - F.col("n")
    starts = counts.select(F.col("_g").alias("_h"), F.col("_s").alias("_t"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_g", "_s").orderBy(*order))
    placed = own.select("*", inside.alias("_inside"))
    on = placed["_g"].eqNullSafe(starts["_h"]) & placed["_s"].eqNullSafe(starts["_t"])
    return placed.join(starts, on).select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def round_robin(rows: DataFrame, group: str, order: list[str], shards: int) -> DataFrame:
    """Rows of each group dealt to shards in turn."""
    return numbered(rows, group, order, "_place").select(*rows.columns, F.pmod(F.col("_place") - 1, F.lit(shards)).cast("int").alias("shard"))


def first_of_each(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in order. Spark keeps n rows of a group in each task before it ranks them."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.select("*", place.alias("place")).where(F.col("place") <= n)


def referenced(rows: DataFrame, references: DataFrame, key: str, method: str, executed: str) -> DataFrame:
    """key, reference: that of the method, or else of the first of the methods (an array) that ran for it and have one."""
    asked = rows.select(key, F.posexplode(F.concat(F.array(method), F.coalesce(executed, F.array().cast("array<string>")))).alias("at", "method"))
    best = asked.join(references.select("method", "reference"), "method").groupBy(key).agg(F.min_by("reference", "at").alias("reference"))
    return rows.select(key).distinct().join(best, key, "left")


def hash_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement in the order of a seeded hash: the same at any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)
