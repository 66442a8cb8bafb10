"""Windows and folds over keys of any size: a crowded key is cut into ranges that tasks share.

A key with more rows than a task's share (all rows over the number of shuffle
partitions) is crowded; there are at most as many of them as partitions. Rows of the
other keys take Spark's own windows. Rows of crowded keys are dealt to ranges by
(key, order); what a window needs of the rows before a range comes with it as a halo,
and what a fold needs is composed from one small function for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from robustlake.storage import settled

PART, HALO = "_part", "_halo"


def share(rows: DataFrame) -> int:
    """Rows of one task if all tasks had equally many."""
    return rows.count() // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1


def crowded(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more rows than a task's share: fewer than there are partitions."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share(rows)).select(F.col(key).alias("_crowded"))


def split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of plain keys, and rows of crowded keys if there are any."""
    keys = crowded(rows, key).collect()
    if not keys:
        return rows, None
    found = F.broadcast(rows.sparkSession.createDataFrame(keys, rows.select(F.col(key).alias("_crowded")).schema))
    on = rows[key].eqNullSafe(found["_crowded"])
    return rows.join(found, on, "left_anti"), rows.join(found, on, "left_semi")


def in_ranges(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` sorted by (key, order) in ranges, whose number is ``_part``; settled, since ranges come from samples."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn(PART, F.spark_partition_id()))


def with_halo(ranges: DataFrame, key: str, order: list[str], reach: int) -> DataFrame:
    """``ranges`` and, marked by ``_halo``, the last ``reach`` rows of the key before each range.

    A range has one row of its key at least, so the tails of the ``reach`` ranges before it are enough.
    """
    columns = [c for c in ranges.columns if c != PART]
    back = Window.partitionBy(key, PART).orderBy(*[F.col(o).desc() for o in order])
    tails = ranges.select("*", F.row_number().over(back).alias("_age")).where(F.col("_age") <= reach)
    tails = tails.groupBy(key, PART).agg(F.sort_array(F.collect_list(F.struct((-F.col("_age")).alias("_at"), F.struct(*columns).alias("row")))).alias("tail"))
    parts = Window.partitionBy(key).orderBy(PART)  # a row for each range of the key
    before = F.concat(*[F.coalesce(F.lag("tail", i).over(parts), F.slice("tail", 1, 0)) for i in range(reach, 0, -1)])
    halos = tails.select(PART, F.slice(F.reverse(before), 1, reach).alias("held"))
    halos = halos.select(F.explode("held").alias("h"), PART).select("h.row.*", PART).withColumn(HALO, F.lit(True))
    return ranges.withColumn(HALO, F.lit(False)).unionByName(halos)


def windowed(rows: DataFrame, key: str, order: list[str], reach: int, work: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """``work(rows, window)`` of a window ordered within each key that looks at most ``reach`` rows back."""
    plain, hot = split(rows, key)
    found = work(plain, Window.partitionBy(key).orderBy(*order))
    if hot is None:
        return found
    ranges = with_halo(in_ranges(hot, key, order), key, order, reach)
    inner = work(ranges, Window.partitionBy(key, PART).orderBy(*order))
    return found.unionByName(inner.where(~F.col(HALO)).drop(PART, HALO))


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each of them within its key, in order."""
    upto = F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    plain, hot = split(rows, key)
    found = plain.withColumn(name, upto)
    if hot is None:
        return found
    ranges = in_ranges(hot, key, order)
    sums = ranges.groupBy(F.col(key).alias("_key"), F.col(PART).alias("_of")).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of a crowded key: fewer than twice the partitions
    sums = F.broadcast(sums.select("_key", "_of", F.sum("_sum").over(ahead).alias("_before")))
    inside = F.sum(value).over(Window.partitionBy(key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = ranges.withColumn("_inside", inside).join(sums, ranges[key].eqNullSafe(sums["_key"]) & (ranges[PART] == sums["_of"]))
    whole = F.when(F.col("_before").isNull() & F.col("_inside").isNull(), None).otherwise(F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)))
    return found.unionByName(own.select(*rows.columns, whole.alias(name)))


#: Most rows of facts that are broadcast whole.
FEW = 50_000


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str = "n") -> DataFrame:
    """``rows`` with the one row of ``facts`` of their key, where there is one; other rows go.

    ``facts`` is a settled table that holds each key's number of rows in ``size``. Up to ``FEW`` facts are broadcast.
    Of more, only those of crowded keys are, of which there are fewer than partitions: rows of a crowded key stay
    where they are, the others are shuffled.
    """
    if facts.count() <= FEW:
        return rows.join(F.broadcast(facts), key)
    total = facts.agg(F.sum(size)).first()[0]
    hot = F.col(size) > total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = F.broadcast(facts.where(hot))
    cold = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti").join(facts.where(~hot), key)
    return cold.unionByName(rows.join(few, key))
