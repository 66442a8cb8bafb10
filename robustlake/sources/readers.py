"""Readers of record logs, documents, listings and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: file name endings of images.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".webp")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines log: blank, malformed and non-object lines are left out; a missing path has no rows."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    kind = spark.createDataFrame([], schema).schema
    marked = StructType([*kind.fields]).add("_bad", "string")
    parsed = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select(*[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object in a file; no rows if the file is missing, broken or not an object."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return documents(whole, schema).drop("value")


def documents(texts: DataFrame, schema: str) -> DataFrame:
    """The columns of ``texts`` and the fields of the JSON object in ``value``; rows that are broken or no object are left out."""
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    found = texts.where(F.col("value").rlike(r"^\s*\{")).select("*", parsed.alias("_r")).where("_r._bad IS NULL")
    return found.select(*texts.columns, "_r.*").drop("_bad")


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative and size of the images below a folder (contents are not read); see ``images``."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException:
        return spark.createDataFrame([], "path string, relative string, size long")
    root = folder.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*" + "/" + root.rsplit("/", 1)[-1] + "/", "")
    return images(files.select("path", relative.alias("relative"), F.col("length").alias("size")), intermediates=False)


def images(listing: DataFrame, intermediates: bool = True) -> DataFrame:
    """Rows of a listing (``relative``: the path below its root) that name images, with those below ``_intermediates`` or without."""
    rows = listing.where(F.lower("relative").rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$"))
    return rows if intermediates else rows.where(~F.col("relative").rlike("(^|/)_intermediates/"))


def probed(keys: DataFrame, listing: DataFrame, now: Column, found_seconds: int = 300, missing_seconds: int = 60) -> DataFrame:
    """key, found, expires_at: each distinct key against a store's listing (``key``), with the time up to which the answer holds."""
    held = listing.select("key").distinct().withColumn("held", F.lit(True))
    rows = keys.select("key").where(F.col("key").isNotNull()).distinct().join(held, "key", "left").select("key", F.coalesce("held", F.lit(False)).alias("found"))
    return rows.select("key", "found", (now + F.when(F.col("found"), found_seconds).otherwise(missing_seconds)).alias("expires_at"))


def relocated(runs: DataFrame, listing: DataFrame) -> DataFrame:
    """``runs`` (run_id, declared, local) with ``root``: the declared folder if the listing (``path``) has it, else the local one if it is there."""
    there = listing.select("path").distinct()
    a, b = there.select(F.col("path").alias("declared"), F.lit(True).alias("_d")), there.select(F.col("path").alias("local"), F.lit(True).alias("_l"))
    found = runs.join(a, "declared", "left").join(b, "local", "left")
    return found.select(*runs.columns, F.when(F.col("_d"), F.col("declared")).when(F.col("_l"), F.col("local")).alias("root"))


def manifest(lines: DataFrame, prefix: str) -> DataFrame:
    """Keys of a text manifest (column ``value``): first token of each line; blanks and comments are left out."""
    token = F.split(F.trim("value"), r"\s+")[0]
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(token.alias("token"))
    path = F.regexp_replace("token", "^(https?|s3)://[^/]*/?", "")
    remote = F.col("token").rlike("^(https?|s3)://")
    return rows.select("token", F.when(remote, path).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace("token", "^/+", ""))).alias("key"))


def device_csv(lines: DataFrame) -> DataFrame:
    """Headerless device metrics of 7 or 8 columns (column ``value``); numbers that do not parse are null."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    others = [c for c in lines.columns if c != "value"]
    rows = lines.select(*others, cells.alias("_c")).where(F.size("_c").between(7, 8))
    number = lambda k: F.get("_c", F.lit(k)).try_cast("double")
    names = ["utilization", "memory_used", "memory_total", "temperature", "power_draw", "power_limit"]
    return rows.select(*others, F.get("_c", F.lit(0)).try_cast("int").alias("device"), F.get("_c", F.lit(1)).alias("name"), *[number(k + 2).alias(n) for k, n in enumerate(names)])


def markdown_table(lines: DataFrame) -> DataFrame:
    """Rows of Markdown tables (columns ``line`` and ``value``) with a number first and a quoted id second; the last row of an id wins."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim("value").startswith("|")).select("line", cells.alias("c")).where(F.size("c") >= 5)
    rows = rows.where(F.col("c")[0].rlike("^[0-9]+$")).select("line", F.regexp_extract(F.col("c")[1], "`([^`]+)`", 1).alias("id"), "c").where("id <> ''")
    return rows.groupBy("id").agg(F.max_by("c", "line").alias("cells"))
