"""Rules of a plan: what a selection may name, which files make it ready, what a cached record must match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How viewpoint methods are named.
MOTION = r"^3d_viewpoint_rerendering_(rotate_forward|swipe|shake|rotate)(?:_[a-z0-9]+)*_(point|ahead)$"
IDENTITY = "identity"
#: The policies and the size of canonical images.
PREPROCESS, OUTPUT, SIZE = "cover-crop", "png", [512, 512]


def motion(method: Column) -> Column:
    """The motion of a viewpoint method; null for others."""
    return F.nullif(F.regexp_extract(method, MOTION, 1), F.lit(""))


def attack_type(method: Column) -> Column:
    """What a method counts as: viewpoint methods by motion; the hidden identity as nothing."""
    return F.when(method != IDENTITY, F.coalesce(F.concat(F.lit("motion:"), motion(method)), method))


def alias_rows(entries: DataFrame, method: str, order: str) -> DataFrame:
    """alias, and the first entry of each motion that stands for it."""
    own = entries.withColumn("_motion", motion(F.col(method))).where("_motion IS NOT NULL")
    held = F.struct(*[F.col(c) for c in entries.columns])
    return own.groupBy("_motion").agg(F.min_by(held, F.col(order)).alias("r")).select(F.concat(F.lit("3d_viewpoint_rerendering_"), "_motion").alias("alias"), "r.*")


def with_baseline(attacks: DataFrame, config: str, attack: str) -> DataFrame:
    """config, attack, hidden: the attacks of each configuration and the identity, hidden unless it was asked for."""
    own = attacks.select(config, attack).distinct()
    asked = own.withColumn("hidden", F.lit(False))
    every = own.select(config).distinct().withColumns({attack: F.lit(IDENTITY), "hidden": F.lit(True)})
    return asked.unionByName(every).groupBy(config, attack).agg(F.every("hidden").alias("hidden"))


def checked(selection: DataFrame, known: DataFrame, config: str, key: str) -> DataFrame:
    """config, asked, unknown (how many ids that ``known`` does not have), names (the first three of them): a configuration with any is refused."""
    rows = selection.select(config, key).distinct().join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    name = F.when(F.col("_known").isNull(), F.col(key).cast("string"))
    found = rows.groupBy(config).agg(F.count(F.lit(1)).alias("asked"), F.count(name).alias("unknown"))
    worst = rows.where("_known IS NULL").groupBy(config).agg(F.array_sort(F.collect_set(key)).alias("ids"))
    return found.join(worst, config, "left").select(config, "asked", "unknown", F.coalesce(F.array_join(F.slice("ids", 1, 3), ", "), F.lit("")).alias("names"))


def require_known(selection: DataFrame, known: DataFrame, config: str, key: str) -> None:
    """Raise if any configuration names an id that is not known."""
    bad = checked(selection, known, config, key).where("unknown > 0").orderBy(config).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r[config]}: unknown {key} {r['names']}" for r in bad))


def files_below(spark, path: str) -> DataFrame:
    """path (relative), length of the files below a folder: listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    start = F.locate(path.split("://")[-1].rstrip("/") + "/", F.col("path"))
    return found.select(F.substr("path", start + len(path.split("://")[-1].rstrip("/")) + 1).alias("path"), "length")


def packs_ready(required: DataFrame, listed: DataFrame) -> DataFrame:
    """pack, files, missing, ready: whether every marker (pack, path) of a pack is among the listed files and is not empty."""
    there = listed.where("length > 0").select("path").distinct().withColumn("_there", F.lit(True))
    rows = required.select("pack", "path").distinct().join(there, "path", "left")
    return rows.groupBy("pack").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("_there").isNull()).alias("missing")).withColumn("ready", F.col("missing") == 0)


#: Fields of a manifest's record that must equal those of the file that is asked for, and what the policy asks for.
SIGNATURE = ("source_relative", "source_size", "source_mtime_ns", "output_path")


def manifest_matches(records: DataFrame, wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """source_relative, differs: which fields of its record keep a wanted file from being reused; none: it is.

    ``records``: the signature, metadata (preprocess_policy, canonical_size), preprocess_policy, canonical_size and
    output_policy; ``wanted``: the signature; ``listed``: path of the files that exist.
    """
    asked = wanted.select(*[F.col(c).alias(f"w_{c}") for c in SIGNATURE])
    there = listed.select(F.col("path").alias("w_output_path")).distinct().withColumn("there", F.lit(True))
    rows = asked.join(there, "w_output_path", "left").join(records, F.col("source_relative") == F.col("w_source_relative"), "left")
    size = F.array(*[F.lit(x) for x in SIZE])
    rules = {c: F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in SIGNATURE} | {
        "metadata.preprocess_policy": F.col("metadata.preprocess_policy").eqNullSafe(F.lit(PREPROCESS)),
        "metadata.canonical_size": F.col("metadata.canonical_size").eqNullSafe(size),
        "preprocess_policy": F.col("preprocess_policy").eqNullSafe(F.lit(PREPROCESS)),
        "canonical_size": F.col("canonical_size").eqNullSafe(size),
        "output_policy": F.col("output_policy").eqNullSafe(F.lit(OUTPUT)),
        "file": F.coalesce("there", F.lit(False)),
    }
    differs = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col("w_source_relative").alias("source_relative"), F.array_join(differs, ",").alias("differs"))


def selection(document: Column, all_ids: Column) -> Column:
    """struct(dataset_ids, max_samples, seeds) of a selection document (JSON): defaults where a member is missing or of no use."""
    ids = F.from_json(F.get_json_object(document, "$.datasetIds"), "array<string>")
    seeds = F.filter(F.from_json(F.get_json_object(document, "$.seeds"), "array<long>"), lambda x: x.isNotNull())
    samples = F.get_json_object(document, "$.maxSamples").try_cast("double").cast("long")
    return F.struct(
        F.when(F.size(ids) > 0, ids).otherwise(F.slice(all_ids, 1, 1)).alias("dataset_ids"),
        F.greatest(F.lit(1).cast("long"), F.coalesce(F.nullif(samples, F.lit(0)), F.lit(1).cast("long"))).alias("max_samples"),
        F.when(F.size(seeds) > 0, seeds).otherwise(F.array(F.lit(42).cast("long"))).alias("seeds"),
    )


def parent_status(shards: DataFrame, units: DataFrame, run: str = "run_id") -> DataFrame:
    """run, status of a run from its shards (status, expected, error) and result units (status).

    Cancelled or paused if any shard is; with errors or missing units, or some failed, partially failed if there is a
    result to show and failed if there is none; failed if all units failed.
    """
    own = shards.groupBy(run).agg(
        F.bool_or(F.col("status") == "cancelled").alias("cancelled"),
        F.bool_or(F.col("status") == "paused").alias("paused"),
        F.count("error").alias("errors"),
        F.sum("expected").alias("expected"),
    )
    done = units.groupBy(run).agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("status") != "succeeded").alias("failed"))
    rows = own.join(done, run, "left").fillna(0, ["units", "failed"])
    some = F.when(F.col("units") > 0, "partially_failed").otherwise("failed")
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("paused"), "paused").when(F.col("errors") > 0, some)
    status = status.when((F.col("expected") > 0) & (F.col("units") < F.col("expected")), some).when(F.col("failed") == 0, "succeeded")
    return rows.select(run, status.when(F.col("failed") < F.col("units"), "partially_failed").otherwise("failed").alias("status"))


def discovered(catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """name, listed, images: the datasets of a catalog (name), and folders (name, images) beside them that hold an image."""
    rows = catalog.select("name").distinct().withColumn("listed", F.lit(True)).join(folders, "name", "full_outer")
    rows = rows.select("name", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("images", F.lit(0).cast("long")).alias("images"))
    return rows.where("listed OR images > 0")


def folder_datasets(images: DataFrame) -> DataFrame:
    """dataset, images, last: images (path below a root) by their first folder; those right below the root are ``local-root``."""
    dataset = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("local-root")
    return images.groupBy(dataset.alias("dataset")).agg(F.count(F.lit(1)).alias("images"), F.max("path").alias("last"))


def paired(references: DataFrame, targets: DataFrame, cell: str, reference_root: str, target_root: str) -> DataFrame:
    """cell, relative, reference, target: paths of either side by what follows their root; a side that is missing is null."""
    side = lambda rows, root, name: rows.where(F.col("path").startswith(root)).select(cell, F.substring("path", len(root) + 1, 1 << 30).alias("relative"), F.col("path").alias(name)).distinct()
    return side(references, reference_root, "reference").join(side(targets, target_root, "target"), [cell, "relative"], "full_outer")


def known_estimate(asked: DataFrame, known: DataFrame, variants: int, samples: Column) -> DataFrame:
    """config, asked, known, n_cells, n_ops, level of configurations (config, dataset, algorithm), of whose datasets only known ones count."""
    rows = asked.distinct().join(known.select("dataset", F.col("dataset").alias("_known")).distinct(), "dataset", "left")
    own = rows.groupBy("config").agg(F.countDistinct("dataset").alias("asked"), F.countDistinct("_known").alias("known"), F.countDistinct("algorithm").alias("_algorithms"))
    own = own.withColumn("n_cells", F.col("known") * F.col("_algorithms") * variants).withColumn("n_ops", F.col("n_cells") * samples)
    return own.withColumn("level", F.when((F.col("n_cells") > 64) | (F.col("n_ops") > 10000), "warn").otherwise("ok")).drop("_algorithms")


def searched(results: DataFrame, text: str = "", status: str | None = None, attack: str | None = None, fields: tuple[str, ...] = ("cell_key", "algorithm_id", "attack_id")) -> DataFrame:
    """Results whose fields hold a text (in any case, spaces around it do not count), of a status and of an attack; None: of any."""
    needle = text.strip().lower()
    hit = F.lit(not needle)
    for field in fields:
        hit = hit | F.contains(F.lower(F.col(field)), F.lit(needle))
    rows = results.where(F.coalesce(hit, F.lit(False)))
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows if attack is None else rows.where(F.col("attack_id") == attack)
