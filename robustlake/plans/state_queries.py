"""Registered queries: logs replayed through legal steps, series over keys of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustlake.operators import kept as K
from robustlake.operators import memo as M
from robustlake.operators import runstate as R
from robustlake.operators import scoring as C
from robustlake.operators import telemetry as T
from robustlake.plans.bindings import cells, requests, table, with_views
from robustlake.plans.registry import query
from robustlake.storage import scratch
from robustlake.streaming import heartbeats as H


def _replay_sql() -> str:
    """Every request with the state it met: one recursion step for each request of a run."""
    steps = ", ".join(f"('{s}', '{a}', '{to}')" for (s, a), to in R.RUN_STEPS.items())
    views = with_views("requests").replace("WITH ", "WITH RECURSIVE ", 1)
    return views + f""", steps(state, action, target) AS (VALUES {steps}),
asked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k FROM requests),
r AS (SELECT run_id, 0::BIGINT AS k, 'absent' AS before, 'absent' AS after, true AS legal FROM (SELECT DISTINCT run_id FROM requests)
  UNION ALL SELECT a.run_id, a.k, r.after, coalesce(s.target, r.after), s.target IS NOT NULL
  FROM r JOIN asked a ON a.run_id = r.run_id AND a.k = r.k + 1 LEFT JOIN steps s ON s.state = r.after AND s.action = a.action),
replayed AS (SELECT a.*, r.before, r.after, r.legal FROM r JOIN asked a ON a.run_id = r.run_id AND a.k = r.k)
"""


@query("c10_run_state", _replay_sql() + """SELECT run_id, CASE WHEN arg_max(after, ord) IN ('pausing', 'cancelling') THEN 'running' ELSE arg_max(after, ord) END AS status,
  arg_max(after, ord) IN ('pausing', 'cancelling', 'paused', 'cancelled') AS cancel_requested, arg_max(after, ord) IN ('paused', 'failed', 'partially_failed') AS resumable,
  arg_max(worker_id, ord) FILTER (WHERE action = 'claim' AND legal) AS worker_id, count(*) FILTER (WHERE legal) AS accepted, count(*) FILTER (WHERE NOT legal) AS refused
FROM replayed GROUP BY 1""")
def run_state(s, d):
    return R.run_states(R.run_log(requests(s, d)))


@query("c10_refusals", _replay_sql() + "SELECT run_id, ord, action, before AS status FROM replayed WHERE NOT legal")
def refusals(s, d):
    return R.run_log(requests(s, d)).where("NOT legal").select("run_id", "ord", "action", F.col("before").alias("status"))


@query("c10_claims", _replay_sql() + """, queue AS (SELECT run_id, row_number() OVER (ORDER BY min_ord, run_id) AS place FROM
  (SELECT run_id, arg_max(after, ord) AS status, min(ord) AS min_ord FROM replayed GROUP BY 1) WHERE status = 'queued'),
asking AS (SELECT 'supplier-' || s_suppkey AS worker_id, row_number() OVER (ORDER BY s_nationkey, 'supplier-' || s_suppkey) AS place FROM supplier)
SELECT run_id, worker_id FROM queue JOIN asking USING (place)""")
def claims(s, d):
    """Queued runs, oldest first, each to one of the suppliers that ask as workers."""
    log = R.run_log(requests(s, d)).groupBy("run_id").agg(F.max_by("after", "ord").alias("status"), F.min("ord").alias("ord"))
    asking = table(s, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey")).alias("worker_id"), F.col("s_nationkey").cast("long").alias("ord"))
    return R.claimed(log, asking)


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1000000

PREVIOUS = """g AS (SELECT user_id, event_id, value, epoch_us(ts) / 1000000 AS s, lag(value) OVER w AS pv, lag(epoch_us(ts) / 1000000) OVER w AS ps, row_number() OVER w AS k
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("w12_energy_power", f"WITH {PREVIOUS}" + """, h AS (SELECT *, coalesce(s > ps AND value < pv, false) AS fell FROM g),
runs AS (SELECT *, sum(CASE WHEN fell THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS run FROM h),
marked AS (SELECT *, fell AND (row_number() OVER (PARTITION BY user_id, run ORDER BY k) - 1) % 2 = 1 AS reset FROM runs),
held AS (SELECT *, coalesce(NOT lag(reset) OVER (PARTITION BY user_id ORDER BY k), false) AS held FROM marked)
SELECT user_id, event_id, round(CASE WHEN held AND NOT fell AND s > ps THEN (value - pv) / (s - ps) / 1e6 END, 12) AS watts FROM held""")
def watts(s, d):
    return T.power(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", seconds()).select("user_id", "event_id", F.round("watts", 12).alias("watts"))


@query("w13_cpu_percent", """WITH c AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1000000 * 100 AS total, epoch_us(ts) / 1000000 * 60 + value * 20000 AS idle FROM events),
g AS (SELECT *, lag(total) OVER w AS pt, lag(idle) OVER w AS pi FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(CASE WHEN total > pt THEN greatest(0, least(100, (1 - (idle - pi) / (total - pt)) * 100)) END, 2) AS percent FROM g""")
def cpu_percent(s, d):
    """A hundred ticks a second, of which some sixty are idle."""
    rows = table(s, d, "events").select("user_id", "ts", "event_id", (seconds() * 100).alias("total"), (seconds() * 60 + F.col("value") * 20000).alias("idle"))
    return T.cpu_percent(rows, "user_id", ["ts", "event_id"], "total", "idle").select("user_id", "event_id", "percent")


@query("k08_kept_scores", with_views("cells") + """
SELECT algorithm_id, attack_id, strength, round(sum(nqd * w) / sum(w), 6) AS nqd, round(sum(tpr * w) / sum(w), 6) AS tpr, CAST(sum(samples) AS BIGINT) AS samples,
  algorithm_id IN ('alg-3', 'alg-20') AS read_again
FROM (SELECT *, CASE WHEN samples > 0 THEN samples ELSE 1 END::DOUBLE AS w FROM cells) GROUP BY 1, 2, 3""")
def kept_scores(s, d):
    """Scores after a second refresh, which one input of more rows than before and a new one cause to be read, and no other."""
    rows = cells(s, d).select(F.col("algorithm_id").alias("unit"), "attack_id", "strength", "nqd", "tpr", "samples", "status")
    folder = scratch(s, "kept-scores")
    source, unit = f"{folder.path}/source", F.col("unit")
    before = rows.where((unit != "alg-20") & ((unit != "alg-3") | (F.col("status") == "succeeded")))
    before.repartition("unit").write.partitionBy("unit").parquet(source)
    store = K.Kept(s, f"{folder.path}/store", K.curve_sums)
    store.refresh(source)
    first = store.manifest().agg(F.max("version")).first()[0]
    late = rows.where(unit.isin("alg-3", "alg-20")).repartition("unit")
    late.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(source)
    store.refresh(source)
    again = store.manifest().select(F.col("unit").alias("algorithm_id"), (F.col("version") > first).alias("read_again"))
    points = K.merged_points(store.sums().withColumnRenamed("unit", "algorithm_id"), "algorithm_id", "attack_id", "strength")
    points = points.join(F.broadcast(again), "algorithm_id")  # a row for each input
    return points.select("algorithm_id", "attack_id", "strength", F.round("nqd", 6).alias("nqd"), F.round("tpr", 6).alias("tpr"), "samples", "read_again")


#: Beats of a run may be six hours apart; a fifth of the beats comes up to two hours late, of which a stream hears within three.
LIMIT, DELAY = 6 * 3600, 3 * 3600


def beats(s, d):
    """Beats of workers on runs, as files in the order of their arrival, and their schema."""
    rows = table(s, d, "events").select("event_id", F.col("user_id").alias("worker_id"), (F.col("user_id") % 40).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    late = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7200).otherwise(0)
    return H.arriving(rows, F.unix_micros("ts") + late * 1_000_000, 6), rows.schema


@query("t04_stale_runs", f"""WITH b AS (SELECT user_id % 40 AS run_id, ts FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) > INTERVAL {LIMIT} SECOND, true) AS begins FROM b),
n AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY run_id ORDER BY ts) AS span FROM g),
s AS (SELECT run_id, min(ts) AS seen_from, max(ts) AS last_seen, max(ts) + INTERVAL {LIMIT} SECOND AS paused_at, count(*) AS beats FROM n GROUP BY run_id, span)
SELECT run_id, epoch_us(seen_from) AS seen_from, epoch_us(last_seen) AS last_seen, epoch_us(paused_at) AS paused_at, beats FROM s WHERE paused_at <= (SELECT max(ts) FROM events) - INTERVAL {DELAY} SECOND""")
def stale_runs(s, d):
    """Pauses that a stream over the beats reports, late ones among them."""
    source, schema = beats(s, d)
    found = H.replayed_silences(s, source, schema, LIMIT, f"{DELAY} seconds")
    return found.select("run_id", *[F.unix_micros(c).alias(c) for c in ("seen_from", "last_seen", "paused_at")], "beats")


@query("t04_stale_batch", f"""WITH b AS (SELECT user_id AS run_id, ts FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) > INTERVAL {4 * LIMIT} SECOND, true) AS begins FROM b),
n AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY run_id ORDER BY ts) AS span FROM g)
SELECT run_id, epoch_us(max(ts)) AS last_seen, count(*) AS beats FROM n GROUP BY run_id, span HAVING max(ts) + INTERVAL {4 * LIMIT} SECOND <= (SELECT max(ts) FROM events) - INTERVAL {DELAY} SECOND""")
def stale_batch(s, d):
    found = H.silences_so_far(table(s, d, "events").withColumnRenamed("user_id", "run_id"), 4 * LIMIT, DELAY)
    return found.select("run_id", F.unix_micros("last_seen").alias("last_seen"), "beats")


@query("t03_heartbeats", "SELECT user_id AS worker_id, max(event_id) AS event_id, user_id % 40 AS run_id, epoch_us(arg_max(ts, event_id)) AS last_seen, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def heartbeats(s, d):
    """The last beat of each worker after a stream over the beats, late ones among them."""
    source, schema = beats(s, d)
    return H.replayed_beats(s, source, schema, "worker_id", "event_id").select("worker_id", "event_id", "run_id", F.unix_micros("ts").alias("last_seen"), "status")


@query("u09_order_statistics", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, s.share, value FROM r JOIN (VALUES (0.001::DOUBLE), (0.5), (0.999)) s(share) ON k = greatest(1, ceil(n * s.share))""")
def order_statistics(s, d):
    """Exact order statistics from a mergeable summary, and of a few values between two of its splitters."""
    parts = [C.order_statistic(table(s, d, "events"), "event_type", "value", x).select("event_type", F.lit(x).alias("share"), "value") for x in (0.001, 0.5, 0.999)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x33_step_cache", """SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS digest, length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS result,
  EXISTS (SELECT 1 FROM documents o WHERE o.lang = 'en' AND coalesce(o.text, '') = coalesce(d.text, '')) AS reused FROM documents d""")
def step_cache(s, d):
    """A step on all documents after a run that had taken it on the English ones: equal contents are computed once, ever."""
    documents = table(s, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("content"))
    held = M.Memo(s, scratch(s, "step-cache").path, "long")
    step = lambda content: F.length(F.regexp_replace(content, "[^a-z]", "")).cast("long")
    held.through(documents.where("lang = 'en'"), "content", "count-letters", {"from": "a", "to": "z"}, step)
    found = held.through(documents, "content", "count-letters", {"to": "z", "from": "a"}, step)
    return found.select("doc_id", F.substring("digest", 1, 16).alias("digest"), "result", "reused")
