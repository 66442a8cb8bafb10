"""Registered queries: record logs, joins and set logic, run state, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.operators import progress as P
from robustlake.operators import records as R
from robustlake.operators import telemetry as T
from robustlake.operators.overlaps import sharing
from robustlake.operators.ranges import running_sum
from robustlake.plans.bindings import cells, log, phases, profile, table, with_views
from robustlake.plans.registry import query

LATEST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY ord DESC) AS age FROM log) WHERE age = 1)"""


@query("a01_compaction", with_views("log") + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cell_key ORDER BY ord DESC) AS age, count(*) OVER (PARTITION BY cell_key) AS versions FROM log)
SELECT cell_key, status, samples, versions FROM ranked WHERE age = 1""")
def compaction(s, d):
    rows = log(s, d)
    counts = rows.groupBy("cell_key").agg(F.max_by(F.struct("status", "samples"), "ord").alias("r"), F.count(F.lit(1)).alias("versions"))
    return counts.select("cell_key", "r.status", "r.samples", "versions")


@query("a02_latest_map", with_views("log") + ", " + LATEST + "SELECT status, count(*) AS n, CAST(sum(samples) AS BIGINT) AS samples FROM last GROUP BY 1")
def latest_map(s, d):
    return R.latest(log(s, d), "cell_key", "ord").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("samples").alias("samples"))


@query("j02_resume_pending", with_views("log") + ", " + LATEST + """, plan AS (SELECT DISTINCT l_orderkey || '-' || k AS cell_key FROM lineitem, range(1, 8) r(k))
SELECT plan.cell_key FROM plan WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.cell_key = plan.cell_key AND last.status = 'succeeded')""")
def resume(s, d):
    orders = table(s, d, "lineitem").select("l_orderkey").distinct()
    plan = orders.select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"), "l_orderkey").select(F.concat_ws("-", "l_orderkey", "k").alias("cell_key"))
    return R.pending(plan, log(s, d), "cell_key", "ord")


@query("j01_matrix_expansion", """SELECT n_name AS dataset_id, r_name AS algorithm_id, p_brand AS attack_id, seed, n_name || '__' || r_name || '__' || p_brand || '__' || seed AS cell_key
FROM nation, region, (SELECT DISTINCT p_brand FROM part) b, (SELECT unnest([1, 2, 3])::INTEGER AS seed) s""")
def matrix(s, d):
    brands, seeds = table(s, d, "part").select("p_brand").distinct(), s.range(1, 4).select(F.col("id").cast("int").alias("seed"))
    # a plan is the product of its four lists: the result is the query
    plan = table(s, d, "nation").select("n_name").crossJoin(F.broadcast(table(s, d, "region").select("r_name"))).crossJoin(F.broadcast(brands)).crossJoin(F.broadcast(seeds))
    return plan.select(
        F.col("n_name").alias("dataset_id"), F.col("r_name").alias("algorithm_id"), F.col("p_brand").alias("attack_id"), "seed",
        F.concat_ws("__", "n_name", "r_name", "p_brand", "seed").alias("cell_key"),
    )


@query("a03_matrix_estimate", """SELECT n_name AS dataset_id, count(DISTINCT c_mktsegment) * 3 * 2 AS n_cells, CAST(sum(least(10, 1 + c_custkey % 20)) AS BIGINT) AS n_samples,
  count(DISTINCT c_mktsegment) * 3 * 2 * greatest(1, CAST(sum(least(10, 1 + c_custkey % 20)) AS BIGINT)) AS n_ops,
  CASE WHEN count(DISTINCT c_mktsegment) * 3 * 2 > 64 OR count(DISTINCT c_mktsegment) * 3 * 2 * greatest(1, CAST(sum(least(10, 1 + c_custkey % 20)) AS BIGINT)) > 10000 THEN 'warn' ELSE 'ok' END AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def estimate(s, d):
    rows = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = rows.groupBy(F.col("n_name").alias("dataset_id")).agg((F.countDistinct("c_mktsegment") * 6).alias("n_cells"), F.sum(F.least(F.lit(10), 1 + F.col("c_custkey") % 20)).alias("n_samples"))
    own = own.withColumn("n_ops", F.col("n_cells") * F.greatest(F.lit(1), F.col("n_samples")))
    return own.withColumn("level", F.when((F.col("n_cells") > 64) | (F.col("n_ops") > 10000), "warn").otherwise("ok"))


@query("j04_alias_lookup", """WITH alias AS (
  SELECT lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS alias, n_nationkey AS id, 1 AS priority FROM nation
  UNION ALL SELECT substr(lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')), 1, 3), n_nationkey, 2 FROM nation
), best AS (SELECT alias, id FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY priority, id) AS k FROM alias) WHERE k = 1)
SELECT c_custkey, best.id AS dataset_id FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN best ON best.alias = CASE WHEN c_custkey % 2 = 0 THEN lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) ELSE substr(lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')), 1, 3) END""")
def alias_lookup(s, d):
    nation = table(s, d, "nation")
    key = F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", ""))
    aliases = nation.select(key.alias("alias"), F.col("n_nationkey").alias("id"), F.lit(1).alias("priority"))
    aliases = aliases.unionByName(nation.select(F.substring(key, 1, 3).alias("alias"), F.col("n_nationkey").alias("id"), F.lit(2).alias("priority")))
    best = R.first_by(aliases, ["alias"], [F.col("priority"), F.col("id")]).select("alias", F.col("id").alias("dataset_id"))
    asked = table(s, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = asked.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, key).otherwise(F.substring(key, 1, 3)).alias("alias"))
    return asked.join(F.broadcast(best), "alias", "left").select("c_custkey", "dataset_id")


@query("j06_control_reuse", with_views("cells") + """, firsts AS (
  SELECT attack_id, strength, seed, algorithm_id, row_number() OVER (PARTITION BY attack_id, strength, seed ORDER BY algorithm_id) AS k
  FROM (SELECT DISTINCT attack_id, strength, seed, algorithm_id FROM cells))
SELECT attack_id, strength, count(*) FILTER (WHERE k = 1) AS computed, count(*) FILTER (WHERE k > 1) AS reused FROM firsts GROUP BY 1, 2""")
def control_reuse(s, d):
    own = cells(s, d).select("attack_id", "strength", "seed", "algorithm_id").distinct()
    place = F.row_number().over(Window.partitionBy("attack_id", "strength", "seed").orderBy("algorithm_id"))
    return own.withColumn("k", place).groupBy("attack_id", "strength").agg(F.count_if(F.col("k") == 1).alias("computed"), F.count_if(F.col("k") > 1).alias("reused"))


@query("j08_manifest_dedup", """SELECT DISTINCT l_orderkey AS dataset_id, l_partkey AS sample_id FROM lineitem WHERE l_returnflag = 'A'
  AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_returnflag = 'R' AND o.l_orderkey = lineitem.l_orderkey AND o.l_partkey = lineitem.l_partkey)""")
def manifest_dedup(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), F.col("l_partkey").alias("sample_id"), "l_returnflag")
    there = rows.where("l_returnflag = 'R'").select("dataset_id", "sample_id")
    return rows.where("l_returnflag = 'A'").select("dataset_id", "sample_id").distinct().join(there, ["dataset_id", "sample_id"], "left_anti")


@query("j12_shared_packs", """WITH packs AS (SELECT p_brand AS pack, p_size AS dir, list(DISTINCT p_partkey % 11) AS markers FROM part GROUP BY 1, 2)
SELECT a.dir, a.pack AS pack, b.pack AS other FROM packs a JOIN packs b ON a.dir = b.dir AND a.pack < b.pack AND list_has_any(a.markers, b.markers)""")
def shared_packs(s, d):
    packs = table(s, d, "part").select(F.col("p_size").alias("dir"), F.col("p_brand").alias("pack"), (F.col("p_partkey") % 11).alias("marker"))
    return sharing(packs, "dir", "pack", "marker")


@query("j15_custom_pool", """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
UNION ALL SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 45))""")
def custom_pool(s, d):
    used = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return R.pool_beside(table(s, d, "part").select("p_partkey"), used)


@query("j16_shard_union", """SELECT 'orders' AS artifact, o_orderkey % 4 AS shard_id, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_id % 4, count(*) FROM events GROUP BY 2""")
def shard_union(s, d):
    orders = table(s, d, "orders").select(F.lit("orders").alias("artifact"), (F.col("o_orderkey") % 4).alias("shard_id"))
    events = table(s, d, "events").select((F.col("event_id") % 4).alias("shard_id"), F.lit("events").alias("artifact"))
    return orders.unionByName(events, allowMissingColumns=True).groupBy("artifact", "shard_id").agg(F.count(F.lit(1)).alias("n"))


@query("j17_cache_reuse", """WITH req AS (SELECT DISTINCT l_suppkey AS cell, l_partkey AS sample FROM lineitem), have AS (SELECT DISTINCT l_suppkey AS cell, l_partkey AS sample FROM lineitem WHERE l_returnflag = 'N')
SELECT req.cell, count(have.cell) AS reused, count(*) - count(have.cell) AS pending FROM req LEFT JOIN have ON req.cell = have.cell AND req.sample = have.sample GROUP BY 1""")
def cache_reuse(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("sample"), "l_returnflag")
    return R.reuse(rows, rows.where("l_returnflag = 'N'"), "cell", "sample")


@query("j18_category_labels", """SELECT p_brand AS category, arg_max(p_type, p_partkey) AS label FROM part GROUP BY 1 UNION ALL SELECT 'local', 'Local'""")
def category_labels(s, d):
    own = table(s, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.max_by("p_type", "p_partkey").alias("label"))
    return own.unionByName(s.range(1).select(F.lit("local").alias("category"), F.lit("Local").alias("label")))


@query("w06_round_robin", """SELECT shard, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
  SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS shard FROM orders) GROUP BY 1""")
def dealt(s, d):
    return R.round_robin(table(s, d, "orders"), "o_orderstatus", ["o_orderkey"], 5).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("w07_position_seed", """SELECT c_custkey, c_nationkey, 42 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seed FROM customer""")
def position_seed(s, d):
    placed = R.numbered(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"])
    return placed.select("c_custkey", "c_nationkey", (F.col("place") + 41).alias("seed"))


@query("o01_first_samples", """SELECT c_nationkey, c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer) WHERE place <= 5""")
def first_samples(s, d):
    return R.first_of_each(table(s, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"], 5)


@query("o03_newest_job", """SELECT o_custkey, max(o_orderdate) AS created_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job FROM orders GROUP BY 1""")
def newest_job(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("created_at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("job"))


@query("o04_seeded_sample", "SELECT p_partkey FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 50")
def seeded_sample(s, d):
    return R.hash_sample(table(s, d, "part").select("p_partkey"), "p_partkey", 7, 50)


ROLLED = """docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, phase, shard_id ORDER BY ord DESC) AS age FROM phases) WHERE age = 1
), rolled AS (SELECT run_id, phase, CAST(sum(current) AS BIGINT) AS current, CAST(sum(total) AS BIGINT) AS total,
  CAST(round_even(sum(current) * 100.0::DOUBLE / sum(total), 0) AS INTEGER) AS percent,
  CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'pending' END AS status,
  count(*) AS shards FROM docs GROUP BY 1, 2)"""


@query("a27_phase_rollup", with_views("phases") + ", " + ROLLED + "SELECT * FROM rolled")
def rollup(s, d):
    return P.phase_rollup(phases(s, d))


@query("a33_run_progress", with_views("phases") + ", " + ROLLED + """
SELECT run_id, CAST(round_even(sum(CASE status WHEN 'succeeded' THEN 1.0::DOUBLE WHEN 'running' THEN percent / 100 ELSE 0 END) / 5 * 100, 0) AS INTEGER) AS progress FROM rolled GROUP BY 1""")
def run_progress(s, d):
    return P.overall(P.phase_rollup(phases(s, d)), 5)


@query("w15_current_phase", with_views("phases") + ", " + ROLLED + "SELECT run_id, coalesce(min(phase) FILTER (WHERE status = 'running'), max(phase) FILTER (WHERE status <> 'pending'), 1) AS phase FROM rolled GROUP BY 1")
def phase_now(s, d):
    return P.current_phase(P.phase_rollup(phases(s, d)))


@query("a32_run_summary", with_views("cells") + """
SELECT algorithm_id, count(*) AS expected, count(*) FILTER (WHERE status = 'succeeded') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) - count(*) FILTER (WHERE status = 'succeeded') AS remaining, CAST(round_even(count(*) FILTER (WHERE status = 'succeeded') * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS percent
FROM cells GROUP BY 1""")
def run_summary(s, d):
    done = F.count_if(F.col("status") == "succeeded")
    return cells(s, d).groupBy("algorithm_id").agg(
        F.count(F.lit(1)).alias("expected"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        (F.count(F.lit(1)) - done).alias("remaining"), P.percent(done, F.count(F.lit(1))).alias("percent"),
    )


@query("a36_execution_summary", with_views("profile") + """
SELECT coalesce(stage, '*') AS stage, coalesce(status, '*') AS status, count(*) AS n, array_to_string(list_sort(list_distinct(list(batch))), ',') AS batches, round(avg(elapsed_ms), 6) AS mean_ms
FROM profile GROUP BY GROUPING SETS ((stage), (status), (stage, status), ())""")
def execution_summary(s, d):
    profile(s, d).createOrReplaceTempView("profile_records")
    return s.sql(
        """SELECT coalesce(stage, '*') AS stage, coalesce(status, '*') AS status, count(*) AS n,
             array_join(array_sort(collect_set(batch)), ',') AS batches, round(avg(elapsed_ms), 6) AS mean_ms
           FROM profile_records GROUP BY GROUPING SETS ((stage), (status), (stage, status), ())"""
    )


@query("a37_elapsed_share", with_views("profile") + "SELECT batch, stage, round(sum(elapsed_ms) OVER (PARTITION BY batch) * n / sum(n) OVER (PARTITION BY batch), 6) AS share_ms FROM (SELECT batch, stage, count(*) AS n, sum(elapsed_ms) AS elapsed_ms FROM profile GROUP BY 1, 2)")
def elapsed_share(s, d):
    own = profile(s, d).groupBy("batch", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ms").alias("ms"))
    batch = Window.partitionBy("batch")
    return own.select("batch", "stage", F.round(F.sum("ms").over(batch) * F.col("n") / F.sum("n").over(batch), 6).alias("share_ms"))


@query("a39_error_concat", with_views("profile") + "SELECT device, string_agg(stage, '; ' ORDER BY event_id) FILTER (WHERE status = 'failed') AS errors FROM profile GROUP BY 1")
def errors(s, d):
    held = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("event_id", "stage"))))
    joined = F.array_join(F.transform(held, lambda e: e["stage"]), "; ")
    return profile(s, d).groupBy("device").agg(F.nullif(joined, F.lit("")).alias("errors"))


@query("a40_best_candidate", with_views("profile") + "SELECT stage, max(round(k / (elapsed_ms + 1), 6)) AS rate, arg_max(batch, (round(k / (elapsed_ms + 1), 6), -event_id)) AS batch FROM profile WHERE status = 'succeeded' GROUP BY 1")
def best_candidate(s, d):
    rate = F.round(F.col("k") / (F.col("elapsed_ms") + 1), 6)
    return profile(s, d).where("status = 'succeeded'").groupBy("stage").agg(F.max(rate).alias("rate"), F.max_by("batch", F.struct(rate, -F.col("event_id"))).alias("batch"))


@query("a28_counter_sum", with_views("profile") + "SELECT device, CAST(sum(k) AS BIGINT) AS total_k, count(k) AS n FROM profile GROUP BY 1")
def counters(s, d):
    pairs = profile(s, d).select("device", F.explode(F.create_map(F.lit("k"), "k")).alias("name", "value"))
    return pairs.groupBy("device").agg(F.sum("value").alias("total_k"), F.count("value").alias("n"))


@query("a38_batch_elapsed", with_views("profile") + "SELECT event_id, elapsed_ms / count(*) OVER (PARTITION BY stage, batch) AS per_item_ms FROM profile")
def batch_elapsed(s, d):
    return profile(s, d).select("event_id", (F.col("elapsed_ms") / F.count(F.lit(1)).over(Window.partitionBy("stage", "batch"))).alias("per_item_ms"))


@query("w18_elapsed_accumulated", with_views("profile") + "SELECT event_id, round(sum(elapsed_ms) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total_ms FROM profile")
def accumulated(s, d):
    own = running_sum(profile(s, d).select("device", "ts", "event_id", "elapsed_ms"), "device", ["ts", "event_id"], "elapsed_ms", "total_ms")
    return own.select("event_id", F.round("total_ms", 4).alias("total_ms"))


@query("p12_worker_fresh", "SELECT user_id AS worker, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR AS fresh FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1")
def worker_fresh(s, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    seen = table(s, d, "events").where(F.col("ts") <= now).groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("last"))
    return seen.select("worker", T.fresh(F.col("last"), now, 6 * 3600 / 5).alias("fresh"))


@query("p14_readiness", with_views("profile") + "SELECT device, CASE WHEN bool_or(status = 'failed' AND stage = 'purchase') THEN 'not_ready' WHEN bool_or(status = 'failed') THEN 'degraded' ELSE 'ready' END AS readiness FROM profile GROUP BY 1")
def readiness(s, d):
    bad = F.col("status") == "failed"
    state = F.when(F.bool_or(bad & (F.col("stage") == "purchase")), "not_ready").when(F.bool_or(bad), "degraded").otherwise("ready")
    return profile(s, d).groupBy("device").agg(state.alias("readiness"))


@query("p06_run_scope", with_views("phases") + "SELECT run_id, bool_or(status = 'running') AS active, bool_or(status IN ('running', 'paused')) AS unfinished FROM phases GROUP BY 1")
def scope(s, d):
    return phases(s, d).groupBy("run_id").agg(F.bool_or(F.col("status") == "running").alias("active"), F.bool_or(F.col("status").isin("running", "paused")).alias("unfinished"))


@query("w08_ema", """WITH RECURSIVE s AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, ts, event_id, k, value AS ema FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.ts, s.event_id, s.k, round_even((r.ema * 0.55::DOUBLE + s.value * (1 - 0.55::DOUBLE)) * 100, 0) / 100 FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, event_id, ema FROM r""")
def ema(s, d):
    return T.smoothed(table(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "ema")


@query("w10_rolling_median", """SELECT user_id, event_id, round(CASE WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] ELSE l[len(l) // 2 + 1] END, 1) AS median
FROM (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS l FROM events)""")
def rolling(s, d):
    return T.rolling_median(table(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "median")


RATE = """g AS (SELECT user_id, event_id, value, epoch_us(ts) / 1000000 AS s, lag(value) OVER w AS pv, lag(epoch_us(ts) / 1000000) OVER w AS ps FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("w11_counter_rate", f"WITH {RATE} SELECT user_id, event_id, round(CASE WHEN s > ps THEN greatest(0, (value - pv) / (s - ps)) END, 9) AS rate FROM g")
def rate(s, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    return T.rates(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", seconds).select("user_id", "event_id", F.round("rate", 9).alias("rate"))


@query("w14_ring_buffer", "SELECT user_id, event_id, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 20")
def ring_buffer(s, d):
    return T.ring(table(s, d, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "age")


@query("m15_gauge", "SELECT event_id, CASE WHEN least(100, greatest(0, value)) >= 90 THEN 'danger' WHEN least(100, greatest(0, value)) >= 75 THEN 'warn' ELSE 'ok' END AS level FROM events")
def gauge_level(s, d):
    return table(s, d, "events").select("event_id", T.gauge(F.col("value")).alias("level"))


@query("w20_palette_index", "SELECT c_custkey, CAST((dense_rank() OVER (ORDER BY c_mktsegment) - 1) % 3 AS INTEGER) AS colour FROM customer")
def palette(s, d):
    rows = table(s, d, "customer")
    # the domain is a handful of names: rank them alone and join back
    names = rows.select("c_mktsegment").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("c_mktsegment")) - 1)
    return rows.join(F.broadcast(names), "c_mktsegment").select("c_custkey", (F.col("k") % 3).alias("colour"))
