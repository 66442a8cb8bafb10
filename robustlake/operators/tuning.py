"""Search for the best candidate setting: all are probed briefly, finalists measured again, round by round.

The state of a search is a table of its measurements. A round asks which
(candidate, samples) measurements it needs and have not been taken, so a driver that is
lost resumes where the table ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.storage import Folder

MEASURED = "item string, candidate long, samples long, round int, rate double, ok boolean"


def probe_samples(candidate, total: int, factor: int):
    """Samples of a first probe: ``factor`` for each unit of a candidate, never more than there are."""
    return F.least(F.lit(total).cast("long"), candidate * factor)


class Search:
    """A search below ``path``. ``measure`` takes (item, candidate, samples) and gives these with ``rate`` and ``ok``."""

    def __init__(self, spark: SparkSession, path: str, measure: Callable[[DataFrame], DataFrame]):
        self._spark, self._folder, self._measure = spark, Folder(spark, path), measure

    def measured(self) -> DataFrame:
        """What has been measured so far; rounds count once they are complete."""
        parts = [f"{self._folder.path}/{n}" for n in self._folder.names() if n.startswith("round-") and self._folder.has(f"{n}/_SUCCESS")]
        return self._spark.read.schema(MEASURED).parquet(*parts) if parts else self._spark.createDataFrame([], MEASURED)

    def _take(self, asked: DataFrame, number: int) -> None:
        """Measure what no complete round has measured."""
        known = self.measured().select("item", "candidate", "samples")
        new = asked.select("item", "candidate", "samples").distinct().join(known, ["item", "candidate", "samples"], "left_anti")
        found = self._measure(new).select("item", "candidate", "samples", F.lit(number).alias("round"), "rate", "ok")
        found.write.mode("overwrite").parquet(f"{self._folder.path}/round-{number:03d}")

    def best(self, samples: int | None = None) -> DataFrame:
        """item, candidate, samples, rate: the highest rate among the successes with the most samples, ties to the smaller candidate."""
        good = self.measured().where("ok AND rate IS NOT NULL")
        order = F.struct("samples", "rate", -F.col("candidate"))
        return good.groupBy("item").agg(F.max_by(F.struct("candidate", "samples", "rate"), order).alias("b")).select("item", "b.*")

    def run(self, candidates: DataFrame, total: int, factor: int = 3, keep: int = 2) -> DataFrame:
        """``best`` after probing all ``candidates`` (item, candidate) and halving the field down to ``keep`` at full length.

        Each round keeps the better half of those that were measured in it, ``keep`` at least, and measures them with
        twice the samples, until the finalists have been measured with all ``total`` samples.
        """
        field = candidates.select("item", F.col("candidate").cast("long").alias("candidate"))
        field = field.withColumn("samples", probe_samples(F.col("candidate"), total, factor))
        number = 0
        while True:
            if not self._folder.has(f"round-{number:03d}/_SUCCESS"):
                self._take(field, number)
            if field.where(F.col("samples") < total).isEmpty():
                return self.best()
            results = self.measured().join(field, ["item", "candidate", "samples"]).where("ok AND rate IS NOT NULL")
            place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("rate").desc(), "candidate"))  # candidates of one item: tens
            left = F.greatest(F.lit(keep), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("item")) / 2))
            kept = results.withColumn("place", place).withColumn("left", left).where("place <= left")
            last = F.col("left") <= keep
            field = kept.select("item", "candidate", F.when(last, F.lit(total).cast("long")).otherwise(F.least(F.lit(total).cast("long"), F.col("samples") * 2)).alias("samples"))
            number += 1
            if field.isEmpty():
                return self.best()
