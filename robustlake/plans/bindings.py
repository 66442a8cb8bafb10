"""Views of the driver's tables in the shape of evaluation records, for Spark and for SQL.

Each view has a Spark function (spark, sf_dir) and a SQL text of the same name in
``SQL``, a common table expression that the oracles put in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Scored cells: one line item is one (algorithm, attack, strength, seed) measurement."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = line.join(orders.select("o_orderkey", "o_orderpriority"), line["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_key"),
        F.concat(F.lit("alg-"), (F.col("l_suppkey") % 21).cast("string")).alias("algorithm_id"),
        F.concat(F.lit("atk-"), (F.col("l_partkey") % 43).cast("string")).alias("attack_id"),
        F.col("o_orderpriority").alias("category"),
        (F.round(F.col("l_discount") * 10) / 10).alias("strength"),
        (F.col("l_quantity") / 50).alias("tpr"),
        F.least(F.lit(1.0), F.col("l_extendedprice") / 120000).alias("nqd"),
        F.col("l_quantity").cast("int").alias("samples"),
        F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("status"),
        F.col("l_linenumber").alias("seed"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    """The append-only record of cells: keys repeat, ``ord`` is the order of arrival."""
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_key"),
        F.when(F.col("l_returnflag") == "N", "succeeded").when(F.col("l_returnflag") == "A", "failed").otherwise("running").alias("status"),
        F.col("l_quantity").cast("long").alias("samples"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Runtime records: stage, device, elapsed time and status of one step."""
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("stage"),
        F.col("user_id").alias("device"),
        "ts",
        F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 5 == 0, "reused").otherwise("succeeded").alias("status"),
        (F.col("event_id") % 16).alias("batch"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def phases(spark: SparkSession, d: str) -> DataFrame:
    """Phase documents of shards: run, shard, phase (1 to 5), status, current, total."""
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_custkey") % 97).alias("run_id"),
        (F.col("o_orderkey") % 8).alias("shard_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("phase"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        (F.col("o_custkey") % 50).alias("current"),
        F.lit(50).cast("long").alias("total"),
        F.col("o_orderkey").alias("ord"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Detection records: label 1 (positive) or 0 (control) and a score, for each language as a cell."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("lang").alias("cell_key"), F.col("quality").alias("label"), ((F.col("n_chars") * 7919 % 1000) / 1000).alias("score")
    )


#: Requests by the share of orders that stand for them; ``archive`` is legal in no state.
ACTIONS = ["create"] * 5 + ["claim"] * 4 + ["pause"] * 3 + ["cancel"] + ["resume"] * 3 + ["stop"] * 2 + ["succeed", "fail", "partial", "stale", "stale", "archive"]


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests to runs in order of arrival: run 0 gets every ninth one."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), ((key * 31 + customer * 17 + F.floor(key / 7)) % len(ACTIONS) + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.when(key % 9 == 0, 0).otherwise(customer).cast("long").alias("run_id"),
        key.alias("ord"),
        action.alias("action"),
        F.concat(F.lit("worker-"), (key % 5).cast("string")).alias("worker_id"),
    )


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 blocks of pixels 0..255, row by row."""
    pixel = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 256))).cast("int")
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("px"))


SQL = {
    "requests": f"""requests AS (
  SELECT CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END AS run_id, o_orderkey AS ord, {ACTIONS!r}[CAST((o_orderkey * 31 + o_custkey * 17 + o_orderkey // 7) % {len(ACTIONS)} + 1 AS INTEGER)] AS action,
    'worker-' || (o_orderkey % 5) AS worker_id FROM orders)""",
    "cells": """cells AS (
  SELECT l_orderkey || '-' || l_linenumber AS cell_key, 'alg-' || (l_suppkey % 21) AS algorithm_id, 'atk-' || (l_partkey % 43) AS attack_id,
    o_orderpriority AS category, round(l_discount * 10) / 10 AS strength, l_quantity / 50 AS tpr,
    least(1.0::DOUBLE, l_extendedprice / 120000) AS nqd, CAST(l_quantity AS INTEGER) AS samples,
    CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'failed' END AS status, l_linenumber AS seed,
    l_shipdate, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "log": """log AS (
  SELECT l_orderkey || '-' || l_linenumber AS cell_key,
    CASE l_returnflag WHEN 'N' THEN 'succeeded' WHEN 'A' THEN 'failed' ELSE 'running' END AS status, CAST(l_quantity AS BIGINT) AS samples,
    row_number() OVER (ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS ord
  FROM lineitem)""",
    "profile": """profile AS (
  SELECT event_id, event_type AS stage, user_id AS device, ts, value AS elapsed_ms,
    CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'reused' ELSE 'succeeded' END AS status,
    event_id % 16 AS batch, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)""",
    "phases": """phases AS (
  SELECT o_custkey % 97 AS run_id, o_orderkey % 8 AS shard_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS phase,
    CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    o_custkey % 50 AS current, 50::BIGINT AS total, o_orderkey AS ord
  FROM orders)""",
    "detections": """detections AS (
  SELECT doc_id, lang AS cell_key, quality AS label, (n_chars * 7919 % 1000) / 1000 AS score FROM documents JOIN labels USING (doc_id))""",
    "blocks": """blocks AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 0.5) * 256))) AS INTEGER)) AS px
  FROM embeddings)""",
}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
