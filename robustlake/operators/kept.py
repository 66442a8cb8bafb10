"""Scores kept by the fingerprint of their input: only inputs that changed are read again.

The source is a table with one folder for each input (``unit=...``). A store keeps
mergeable partial sums of each input next to the fingerprint of the files they came
from. A refresh lists the files, reads the inputs whose fingerprint is new, and writes
their sums and a manifest that says which version holds each input's sums. A version
counts once its manifest is complete, which is the last thing written; a refresh that
dies leaves the store as it was. Scores merge the sums of all inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from robustlake.storage import Folder, settings, settled

#: Versions that a manifest may name before all sums are written anew in one.
VERSIONS = 8
#: Fixed value: the folder name of rows without an input's name, which stands for it here.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Changed inputs that are read by their folders' names; more are read through a join on the input's name.
NAMED = 1000


def fingerprints(spark: SparkSession, source: str) -> DataFrame:
    """unit, fingerprint: of the names, sizes and times of each input's files. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
    unit = F.url_decode(F.replace(F.regexp_extract("path", r"/unit=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    files = files.select(unit.alias("unit"), F.concat_ws("|", "path", F.col("length"), F.unix_micros("modificationTime")).alias("file"))
    # order does not matter: a sum of hashes is a partial aggregate, however many files an input has
    digest = F.conv(F.substring(F.sha2("file", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.where("unit <> ''").groupBy("unit").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(digest)).alias("fingerprint"))


class Kept:
    """A store of partial sums at ``path``; ``partial`` makes them (one row a key) from rows of the source, with ``unit`` among the keys."""

    def __init__(self, spark: SparkSession, path: str, partial: Callable[[DataFrame], DataFrame]):
        self._spark, self._folder, self._partial = spark, Folder(spark, path), partial

    def _versions(self) -> list[int]:
        found = [int(n.split("-")[1]) for n in self._folder.names() if n.startswith("manifest-")]
        return sorted(v for v in found if self._folder.has(f"manifest-{v:09d}/_SUCCESS"))

    def manifest(self) -> DataFrame:
        """unit, fingerprint, version: what the store holds now."""
        versions = self._versions()
        schema = "unit string, fingerprint string, version long"
        if not versions:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(f"{self._folder.path}/manifest-{versions[-1]:09d}")

    def changes(self, source: str) -> DataFrame:
        """unit, fingerprint, version, change: kept, read (new or changed) or dropped."""
        now, held = fingerprints(self._spark, source), self.manifest().withColumnRenamed("fingerprint", "old")
        change = F.when(F.col("fingerprint").isNull(), "dropped").when(F.col("old").eqNullSafe(F.col("fingerprint")), "kept").otherwise("read")
        return now.join(held, "unit", "full_outer").select("unit", "fingerprint", "version", change.alias("change"))

    def _rows(self, source: str, changed: DataFrame, count: int) -> DataFrame:
        unit = F.coalesce(F.col("unit").cast("string"), F.lit(NO_NAME))
        with settings(self._spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):  # names stay as they are written
            read = self._spark.read.option("basePath", source).parquet
            if count > NAMED:
                return read(source).withColumn("unit", unit).join(changed.select("unit"), "unit", "left_semi")
            folders = changed.select(F.concat(F.lit("unit="), _escaped("unit")).alias("folder")).collect()
            return read(*sorted(f"{source}/{r['folder']}" for r in folders)).withColumn("unit", unit)

    def refresh(self, source: str) -> dict[str, int]:
        """Bring the store up to date; how many inputs were kept, read and dropped."""
        versions = self._versions()
        version = 1 + max([0, *versions, *[int(n.split("=")[1]) for n in self._folder.names() if n.startswith("version=")]])
        found = settled(self.changes(source))  # one listing decides what is read and what the manifest says
        counts = {"kept": 0, "read": 0, "dropped": 0} | {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
        if counts["read"] or counts["dropped"]:
            changed = found.where("change = 'read'")
            many = found.where("change = 'kept'").select("version").distinct().count() >= VERSIONS
            parts = []
            if counts["read"]:
                parts.append(self._partial(self._rows(source, changed, counts["read"])))
            if many:
                parts.append(self._sums(found.where("change = 'kept'")))
            if parts:
                rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                rows.write.mode("overwrite").parquet(f"{self._folder.path}/version={version}")
            own = F.when((F.col("change") == "read") | F.lit(many), version).otherwise(F.col("version")).cast("long")
            left = found.where("change <> 'dropped'").select("unit", "fingerprint", own.alias("version"))
            left.write.mode("overwrite").parquet(f"{self._folder.path}/manifest-{version:09d}")
            self._forget()
        return counts

    def _forget(self) -> None:
        """Drop what neither the newest manifest nor the one before it names: readers may still hold that one."""
        versions = self._versions()
        needed: set[int] = set()
        for v in versions[-2:]:
            needed |= {r["version"] for r in self._spark.read.parquet(f"{self._folder.path}/manifest-{v:09d}").select("version").distinct().collect()}
        for name in self._folder.names():
            kind, _, number = name.replace("=", "-").partition("-")
            if kind == "manifest" and int(number) not in versions[-2:] or kind == "version" and int(number) not in needed:
                self._folder.drop(name)

    def _sums(self, manifest: DataFrame) -> DataFrame:
        """Partial sums of the inputs of a manifest, each from the version that it names."""
        versions = [r["version"] for r in manifest.select("version").distinct().collect()]
        sums = self._spark.read.option("basePath", self._folder.path).parquet(*[f"{self._folder.path}/version={v}" for v in versions])
        sums = sums.withColumn("version", F.col("version").cast("long")).withColumn("unit", F.col("unit").cast("string"))
        return sums.join(manifest.select("unit", "version"), ["unit", "version"], "left_semi").drop("version")

    def sums(self) -> DataFrame:
        """All partial sums that the store holds; empty stores have none to tell the columns from."""
        held = self.manifest()
        if held.isEmpty():
            raise AnalysisException("the store holds nothing yet: refresh it first")
        return self._sums(held)


def _escaped(name: str):
    """A folder name as the writer spells it: characters that a path cannot hold as %XX."""
    special = "[\\x01-\\x1F\\x7F\"#%'*/:=?\\\\{\\[\\]\\^]"
    chars = F.split(F.col(name), "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(special), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")


def curve_sums(rows: DataFrame) -> DataFrame:
    """Mergeable sums of curve points: weighted degradation and detection, weight and samples of each input and point."""
    weight = F.when(F.col("samples") > 0, F.col("samples")).otherwise(F.lit(1)).cast("double")
    return rows.groupBy("unit", "attack_id", "strength").agg(
        F.sum(F.col("nqd") * weight).alias("x"), F.sum(F.col("tpr") * weight).alias("y"), F.sum(weight).alias("w"), F.sum("samples").cast("long").alias("samples")
    )


def merged_points(sums: DataFrame, *keys: str) -> DataFrame:
    """Curve points of all inputs from their sums."""
    points = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("x", "y", "w", "samples")])
    return points.select(*keys, (F.col("x") / F.col("w")).alias("nqd"), (F.col("y") / F.col("w")).alias("tpr"), "samples")
