"""Registered queries: planning, catalog look-ups, state roll-ups and further scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.functions import strings as S
from robustlake.operators import progress as P
from robustlake.operators import records as R
from robustlake.operators import telemetry as T
from robustlake.plans.bindings import cells, phases, profile, table, with_views
from robustlake.plans.registry import query


@query("p01_envelope", "SELECT event_id, coalesce(json_extract_string(props, '$.recordSchema'), 'runtime_profile') AS record_schema, 1 AS schema_version FROM events")
def envelope(s, d):
    own = F.get_json_object("props", "$.recordSchema")
    return table(s, d, "events").select("event_id", F.coalesce(own, F.lit("runtime_profile")).alias("record_schema"), F.lit(1).alias("schema_version"))


@query("p05_param_patch", """SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS' OR p_partkey % 3 = 0 THEN 'save_intermediates=false,size=' || p_size ELSE 'size=' || p_size END AS params FROM part""")
def param_patch(s, d):
    base = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    patched = F.when(F.col("p_type").rlike("BRASS$") | (F.col("p_partkey") % 3 == 0), F.map_concat(base, F.create_map(F.lit("save_intermediates"), F.lit("false")))).otherwise(base)
    pairs = F.transform(F.array_sort(F.map_entries(patched)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(s, d, "part").select("p_partkey", F.array_join(pairs, ",").alias("params"))


@query("p09_curve_filter", with_views("cells") + "SELECT algorithm_id, count(*) AS n FROM cells WHERE category = '2-HIGH' AND attack_id IN ('atk-1', 'atk-2', 'atk-3') GROUP BY 1")
def curve_filter(s, d):
    return cells(s, d).where((F.col("category") == "2-HIGH") & F.col("attack_id").isin("atk-1", "atk-2", "atk-3")).groupBy("algorithm_id").agg(F.count(F.lit(1)).alias("n"))


@query("p11_hidden", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22') AND p_type NOT LIKE 'PROMO%'")
def hidden(s, d):
    return table(s, d, "part").where(~F.col("p_brand").isin("Brand#11", "Brand#22") & ~F.col("p_type").startswith("PROMO")).select("p_partkey", "p_brand")


@query("p15_stage_status", with_views("profile") + """SELECT device, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) < 20 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 AND count(*) < 20 THEN 'missing results' END AS error FROM profile GROUP BY 1""")
def stage_status(s, d):
    bad, few = F.count_if(F.col("status") == "failed") > 0, F.count(F.lit(1)) < 20
    return profile(s, d).groupBy("device").agg(F.when(bad | few, "failed").otherwise("succeeded").alias("status"), F.when(~bad & few, "missing results").alias("error"))


@query("j03_priority_lookup", """WITH names AS (SELECT p_partkey AS id, p_name AS name, 1 AS priority FROM part UNION ALL SELECT p_partkey, p_brand, 2 FROM part UNION ALL SELECT p_partkey, p_type, 3 FROM part),
best AS (SELECT name, arg_min(id, (priority, id)) AS id, min(priority) AS priority FROM names GROUP BY 1), asked AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT 'nowhere')
SELECT asked.name, best.id, best.priority FROM asked LEFT JOIN best USING (name)""")
def priority_lookup(s, d):
    part = table(s, d, "part")
    names = None
    for k, c in enumerate(("p_name", "p_brand", "p_type"), 1):
        own = part.select(F.col("p_partkey").alias("id"), F.col(c).alias("name"), F.lit(k).alias("priority"))
        names = own if names is None else names.unionByName(own)
    best = R.first_by(names, ["name"], [F.col("priority"), F.col("id")])
    asked = part.select(F.col("p_brand").alias("name")).union(part.select("p_type")).union(s.range(1).select(F.lit("nowhere"))).distinct()
    return asked.join(best, "name", "left").select("name", "id", "priority")


@query("j09_shard_context", "SELECT o_orderkey, n_name AS device, 'run-' || (o_custkey % 97) || '/shard-' || (o_orderkey % 8) AS shard_key FROM orders JOIN nation ON o_orderkey % 8 = n_nationkey")
def shard_context(s, d):
    shards = F.broadcast(table(s, d, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("shard"), F.col("n_name").alias("device")))
    own = table(s, d, "orders").withColumn("shard", F.col("o_orderkey") % 8)
    return own.join(shards, "shard").select("o_orderkey", "device", F.concat(F.lit("run-"), F.col("o_custkey") % 97, F.lit("/shard-"), F.col("shard")).alias("shard_key"))


@query("j10_phase_defaults", with_views("phases") + """, grid AS (SELECT r.run_id, CAST(p.phase AS INTEGER) AS phase FROM (SELECT DISTINCT run_id FROM phases) r, range(1, 8) p(phase)), docs AS (
  SELECT run_id, phase, arg_min(status, ord) AS status FROM phases GROUP BY 1, 2)
SELECT run_id, phase, coalesce(status, 'pending') AS status FROM grid LEFT JOIN docs USING (run_id, phase)""")
def phase_defaults(s, d):
    own = phases(s, d)
    grid = own.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("phase"))
    docs = own.groupBy("run_id", "phase").agg(F.min_by("status", "ord").alias("status"))
    return grid.join(docs, ["run_id", "phase"], "left").select("run_id", "phase", F.coalesce("status", F.lit("pending")).alias("status"))


@query("j19_merged_links", """WITH up AS (SELECT page_id, url, 1 AS source FROM pages WHERE page_id % 3 = 0), own AS (SELECT page_id, url FROM pages WHERE page_id % 2 = 0)
SELECT url, arg_min(page_id, page_id) AS page_id FROM (SELECT page_id, url FROM own UNION ALL SELECT page_id, url FROM up WHERE url NOT IN (SELECT url FROM own)) GROUP BY 1""")
def merged_links(s, d):
    pages = table(s, d, "pages").select("page_id", "url")
    own, up = pages.where("page_id % 2 = 0"), pages.where("page_id % 3 = 0")
    rows = own.unionByName(up.join(own.select("url"), "url", "left_anti").select("page_id", "url"))
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("a07_run_stats", with_views("phases") + "SELECT run_id, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'succeeded') AS succeeded FROM phases GROUP BY 1")
def run_stats(s, d):
    return phases(s, d).groupBy("run_id").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))


@query("a24_weight_percent", "SELECT p_partkey, CAST(floor(p_size * 100.0::DOUBLE / (p_size + 30 + 20) + 0.5) AS BIGINT) AS robustness, CAST(floor(30 * 100.0::DOUBLE / (p_size + 30 + 20) + 0.5) AS BIGINT) AS fidelity FROM part")
def weight_percent(s, d):
    total = F.col("p_size") + 50
    return table(s, d, "part").select("p_partkey", F.floor(F.col("p_size") * 100.0 / total + 0.5).alias("robustness"), F.floor(F.lit(3000.0) / total + 0.5).alias("fidelity"))


@query("a25_radar", with_views("cells") + "SELECT algorithm_id, category, round(avg(a), 9) AS score FROM (SELECT algorithm_id, category, attack_id, avg(tpr) AS a FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2")
def radar(s, d):
    own = cells(s, d).groupBy("algorithm_id", "category", "attack_id").agg(F.avg("tpr").alias("a"))
    return own.groupBy("algorithm_id", "category").agg(F.round(F.avg("a"), 9).alias("score"))


@query("a26_radar_total", with_views("cells") + "SELECT algorithm_id, round(sum(least(1, greatest(0, s))), 6) AS total FROM (SELECT algorithm_id, category, avg(tpr) * 1.5 AS s FROM cells GROUP BY 1, 2) GROUP BY 1")
def radar_total(s, d):
    own = cells(s, d).groupBy("algorithm_id", "category").agg((F.avg("tpr") * 1.5).alias("s"))
    return own.groupBy("algorithm_id").agg(F.round(F.sum(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s")))), 6).alias("total"))


@query("a29_latest_item", with_views("phases") + "SELECT run_id, phase, arg_max(ord, shard_id * 1000000000 + ord) FILTER (WHERE current > 10) AS item FROM phases GROUP BY 1, 2")
def latest_item(s, d):
    some = F.col("current") > 10
    return phases(s, d).groupBy("run_id", "phase").agg(F.max_by(F.when(some, F.col("ord")), F.when(some, F.struct("shard_id", "ord"))).alias("item"))


@query("w02_metric_rank", with_views("cells") + "SELECT category, algorithm_id, CAST(row_number() OVER (PARTITION BY category ORDER BY m DESC, algorithm_id) AS INTEGER) AS rank FROM (SELECT category, algorithm_id, round(avg(nqd), 6) AS m FROM cells GROUP BY 1, 2)")
def metric_rank(s, d):
    own = cells(s, d).groupBy("category", "algorithm_id").agg(F.round(F.avg("nqd"), 6).alias("m"))
    return own.select("category", "algorithm_id", F.row_number().over(Window.partitionBy("category").orderBy(F.col("m").desc(), "algorithm_id")).alias("rank"))


@query("w17_accuracy_series", with_views("cells") + "SELECT algorithm_id, count(*) AS n_points, min(strength) AS first, max(strength) AS last FROM (SELECT DISTINCT algorithm_id, strength FROM cells WHERE status = 'succeeded') GROUP BY 1 HAVING count(*) >= 2")
def accuracy_series(s, d):
    own = cells(s, d).where("status = 'succeeded'").select("algorithm_id", "strength").distinct()
    return own.groupBy("algorithm_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("strength").alias("first"), F.max("strength").alias("last")).where("n_points >= 2")


@query("o08_log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def log_tail(s, d):
    return table(s, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(40).select("event_id", "event_type")


@query("f11_variant_label", "SELECT p_partkey, 'model=' || p_brand || CASE WHEN p_size > 25 THEN ',type=' || p_type ELSE '' END AS label, CAST(p_size AS DOUBLE) AS strength FROM part")
def variant_label(s, d):
    params = F.create_map(F.lit("model"), F.col("p_brand"), F.lit("quality"), F.col("p_size").cast("string"), F.lit("type"), F.when(F.col("p_size") > 25, F.col("p_type")))
    rest = F.map_entries(F.map_filter(params, lambda k, v: (k != "quality") & v.isNotNull()))
    label = F.array_join(F.transform(rest, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(s, d, "part").select("p_partkey", label.alias("label"), F.element_at(params, "quality").try_cast("double").alias("strength"))


@query("f19_links", "SELECT p_partkey, 2::BIGINT AS n, p_brand || ' -> http://x/' || p_partkey AS first FROM part")
def link_list(s, d):
    text = F.concat(F.lit("see ["), F.col("p_brand"), F.lit("](http://x/"), F.col("p_partkey"), F.lit(") and [b](y)"))
    own = table(s, d, "part").select("p_partkey", S.links(text).alias("l"))
    return own.select("p_partkey", F.size("l").cast("long").alias("n"), F.concat_ws(" -> ", F.col("l")[0]["label"], F.col("l")[0]["url"]).alias("first"))


@query("f21_language_fallback", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'de' THEN substr(text, 1, 20) ELSE '' END, ''), source, '') AS summary FROM documents")
def fallback(s, d):
    own = F.when(F.col("lang") == "de", F.substring("text", 1, 20)).otherwise("")
    return table(s, d, "documents").select("doc_id", F.coalesce(F.nullif(own, F.lit("")), F.col("source"), F.lit("")).alias("summary"))


@query("m04_phase_digest", "SELECT event_id, CAST('0x' || substr(sha256(event_id || ':' || props), 16, 1) AS INTEGER) % 8 AS phase FROM events")
def phase_digest(s, d):
    digit = F.conv(F.substring(F.sha2(F.concat_ws(":", "event_id", "props"), 256), 16, 1), 16, 10).cast("int")
    return table(s, d, "events").select("event_id", (digit % 8).alias("phase"))


@query("m05_camera_path", "SELECT event_id, round(cos(2 * pi() * (event_id % 8) / 8) * 0.02, 9) + 0.0 AS x, round(sin(2 * pi() * (event_id % 8) / 8) * 0.02, 9) + 0.0 AS y FROM events")
def camera_path(s, d):
    angle = 2 * F.pi() * (F.col("event_id") % 8) / 8
    return table(s, d, "events").select("event_id", (F.round(F.cos(angle) * 0.02, 9) + 0.0).alias("x"), (F.round(F.sin(angle) * 0.02, 9) + 0.0).alias("y"))


@query("m14_batch_resolution", "SELECT p_partkey, greatest(1, least(p_partkey % 9, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size % 6 END, CASE WHEN p_size % 3 = 0 THEN 8 END, 4))) AS batch FROM part")
def batch_resolution(s, d):
    asked = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 6), F.when(F.col("p_size") % 3 == 0, 8), F.lit(4))
    return table(s, d, "part").select("p_partkey", F.greatest(F.lit(1), F.least(F.col("p_partkey") % 9, asked)).cast("long").alias("batch"))


@query("c07_shard_specs", """SELECT shard, count(*) AS n_samples, count(DISTINCT c_nationkey) AS n_datasets, max(place) + 1 AS max_samples FROM (
  SELECT *, (k - 1) % 5 AS shard, (k - 1) // 5 AS place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)) GROUP BY 1""")
def shard_specs(s, d):
    dealt = R.round_robin(table(s, d, "customer"), "c_nationkey", ["c_custkey"], 5)
    lists = dealt.groupBy("shard", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return lists.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_datasets"), F.max("n").alias("max_samples"))


@query("c14_override_merge", "SELECT p_partkey, 'cew_s2=4,noise_to_image=' || (p_size + 1) AS merged FROM part")
def override_merge(s, d):
    base, more = S.overrides(F.lit("cew_s2=4,noise_to_image=1")), S.overrides(F.concat(F.lit("noise_to_image="), F.col("p_size") + 1))
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k))
    pairs = F.array_sort(F.map_entries(F.map_concat(rest, more)))
    return table(s, d, "part").select("p_partkey", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("w09_jump_ema", """WITH RECURSIVE s AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, value AS ema FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.event_id, s.k,
  CASE WHEN abs(s.value - r.ema) <= 40 THEN round_even((r.ema * 0.55::DOUBLE + s.value * (1 - 0.55::DOUBLE)) * 100, 0) / 100 ELSE s.value END FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, event_id, ema FROM r""")
def jump_ema(s, d):
    return T.smoothed(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", keep=0.55, jump=40.0).select("user_id", "event_id", "ema")
