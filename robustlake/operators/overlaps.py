"""Sets that share a member, found through an inverted index of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustlake.operators.records import numbered
from robustlake.storage import settled

#: Sets of one member that one task compares with the others.
PART = 512


def sharing(packs: DataFrame, group: str, pack: str, marker: str) -> DataFrame:
    """group, pack, other: pairs (pack < other) of one group that share a marker, each pair once.

    ``packs`` has a row for each marker of a pack. Markers are ranked in their group, the rarest first, and each pair
    is met at the rarest marker it shares: at a more common one it is left out, because a rarer one is shared as well.
    A marker of many packs is cut into parts of ``PART``, so a task meets the packs of two parts, not of a marker.
    """
    own = packs.select(F.col(group).alias("g"), F.col(pack).alias("p"), F.col(marker).alias("m")).where("m IS NOT NULL AND p IS NOT NULL").distinct()
    own = settled(own)
    counts = own.groupBy("g", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a marker of one pack joins nothing
    posted = own.alias("o").join(counts.alias("c"), F.expr("o.g <=> c.g AND o.m = c.m")).select("o.g", "o.p", "o.m", "n")
    # markers of each pack by rarity: a pack's own list, which is small, tells for two packs which shared one comes first
    lists = posted.groupBy("g", "p").agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("marks"))
    rows = settled(lists.select("g", "p", "marks", F.explode("marks").alias("x")).select("g", "p", "marks", "x.n", "x.m"))
    placed = numbered(rows.withColumns({"_key": F.struct("g", "m"), "_order": F.pmod(F.xxhash64("p"), F.lit(1 << 40))}), "_key", ["_order", "p"], "_place", width=1 << 30)
    parts = placed.withColumns({"part": F.floor((F.col("_place") - 1) / PART), "parts": F.ceil(F.col("n") / PART)})
    # each part meets itself and every later part of its marker
    left = parts.select("*", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("meets")).select("g", "m", "part", "meets", F.col("p").alias("a"), F.col("marks").alias("a_marks"))
    right = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))).alias("met")).select(F.col("g").alias("g2"), F.col("m").alias("m2"), F.col("met").alias("part2"), F.col("part").alias("meets2"), F.col("p").alias("b"), F.col("marks").alias("b_marks"))
    on = left["g"].eqNullSafe(right["g2"]) & (left["m"] == right["m2"]) & (left["part"] == right["part2"]) & (left["meets"] == right["meets2"])
    pairs = left.join(right, on).where((F.col("part") < F.col("meets")) & (F.col("a") != F.col("b")) | (F.col("part") == F.col("meets")) & (F.col("a") < F.col("b")))
    first = F.element_at(F.array_intersect("a_marks", "b_marks"), 1)["m"]  # both lists are by rarity
    met = pairs.where(first == F.col("m"))
    return met.select(F.col("g").alias(group), F.least("a", "b").alias(pack), F.greatest("a", "b").alias("other"))
