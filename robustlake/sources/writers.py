"""Writers: record logs, CSV exports and run artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.functions.strings import js_number


def _enveloped(records: DataFrame, schema_name: str, version: int) -> DataFrame:
    envelope = {"recordSchema": F.lit(schema_name), "schemaVersion": F.lit(version)}
    return records.withColumns({k: v for k, v in envelope.items() if k not in records.columns})


def append_log(records: DataFrame, path: str, schema_name: str, version: int = 1) -> None:
    """Append records as JSON lines with their envelope; columns of the payload win over it."""
    _enveloped(records, schema_name, version).write.mode("append").json(path)


def write_log(records: DataFrame, path: str, schema_name: str, version: int = 1) -> None:
    """The same, in place of what the log held."""
    _enveloped(records, schema_name, version).write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str) -> None:
    """A document of one row as one JSON object in one file."""
    rows.limit(1).coalesce(1).write.mode("overwrite").json(path)


def quoted(x: Column) -> Column:
    """A CSV field: always quoted, quotes doubled, numbers as JavaScript writes them; null is empty."""
    return F.concat(F.lit('"'), F.coalesce(F.replace(js_number(x), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"'))


def quoted_line(*fields: Column) -> Column:
    return F.concat_ws(",", *[quoted(f) for f in fields])


#: Columns of the exports, in order.
RESULT_COLUMNS = "run_id result_unit_key algorithm_id attack_preset_id attack_strength status bit_accuracy ber tpr_at_fpr nqd manifest_path".split()
LEADERBOARD_COLUMNS = "rank algorithm_id protocol_status wrs clean_fidelity avg_nqd coverage runtime_ms run_id".split()


def csv_lines(rows: DataFrame, columns: list[str], order: list[str], trailer: Column | None = None) -> DataFrame:
    """section, at, line: a header (0), a line for each row (1) in the order ``at``, then a blank line (2) and a trailer (3), if any."""
    spark = rows.sparkSession
    at = F.struct(*[F.col(c).alias(c) for c in order])
    body = rows.select(F.lit(1).alias("section"), at.alias("at"), quoted_line(*[F.col(c) for c in columns]).alias("line"))
    one = spark.range(1)
    others = [(0, quoted_line(*[F.lit(c) for c in columns]))] + ([(2, F.lit("")), (3, trailer)] if trailer is not None else [])
    for section, line in others:
        body = body.unionByName(one.select(F.lit(section).alias("section"), F.lit(None).cast(body.schema["at"].dataType).alias("at"), line.alias("line")))
    return body


def results_csv(rows: DataFrame, order: list[str], protocol: str, status: str, wrs: float | None) -> DataFrame:
    """A run's results with the protocol they were scored by: ``csv_lines`` of RESULT_COLUMNS."""
    trailer = quoted_line(*[F.lit(x) for x in ("protocol_id", protocol, "status", status, "wrs")], F.lit(wrs))
    return csv_lines(rows, RESULT_COLUMNS, order, trailer)


def leaderboard_csv(rows: DataFrame) -> DataFrame:
    """``csv_lines`` of LEADERBOARD_COLUMNS by rank."""
    return csv_lines(rows, LEADERBOARD_COLUMNS, ["rank"])


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of ``csv_lines`` as text whose part files follow each other in order."""
    dealt = lines.repartitionByRange("section", "at").sortWithinPartitions("section", "at")
    dealt.select("line").write.mode("overwrite").text(path)


def ranking_exports(leaderboard: DataFrame, attacks: DataFrame, profiles: DataFrame, path: str) -> None:
    """leaderboard.csv, attack_leaderboard.csv, method_profiles.csv and ranking_summary.json below a folder."""
    write_lines(leaderboard_csv(leaderboard), f"{path}/leaderboard.csv")
    for name, rows in (("attack_leaderboard.csv", attacks), ("method_profiles.csv", profiles)):
        write_lines(csv_lines(rows, rows.columns, rows.columns[:1]), f"{path}/{name}")
    summary = leaderboard.agg(F.count(F.lit(1)).alias("algorithms"), F.max("wrs").alias("best_wrs"), F.max_by("algorithm_id", F.struct("wrs", "algorithm_id")).alias("best"))
    write_document(summary, f"{path}/ranking_summary.json")


def manifest_rows(records: DataFrame, keys: list[str], path: str) -> None:
    """Manifests of a step (embedding, extraction, attack): one Parquet folder for each value of the keys."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def artifacts(records: DataFrame, path: str) -> None:
    """A run's records as Parquet, one folder for each run."""
    records.write.mode("append").partitionBy("run_id").parquet(path)
