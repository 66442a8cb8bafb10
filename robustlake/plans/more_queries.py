"""Registered queries: sources and exports on tables, label and size functions, readiness and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.functions import pixels as X
from robustlake.functions import strings as S
from robustlake.operators import progress as P
from robustlake.operators import records as R
from robustlake.operators import scoring as C
from robustlake.plans.bindings import blocks, cells, detections, phases, profile, table, with_views
from robustlake.plans.registry import query
from robustlake.sources.readers import manifest


@query("s08_manifest_keys", "SELECT url AS token, regexp_replace(url, '^(https?|s3)://[^/]*/?', '') AS key FROM pages WHERE trim(url) <> '' AND url NOT LIKE '#%'")
def manifest_keys(s, d):
    return manifest(table(s, d, "pages").select(F.col("url").alias("value")), "root")


@query("s12_canonical_manifest", with_views("log") + "SELECT cell_key, arg_max(samples, ord) AS samples FROM log WHERE samples IS NOT NULL AND status <> 'running' GROUP BY 1")
def canonical_manifest(s, d):
    return R.latest(log_of(s, d).where("samples IS NOT NULL AND status <> 'running'"), "cell_key", "ord").select("cell_key", "samples")


def log_of(s, d):
    from robustlake.plans.bindings import log

    return log(s, d)


@query("k06_archive_names", "SELECT doc_id, source, printf('%06d.txt', row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS name FROM documents")
def archive_names(s, d):
    placed = R.numbered(table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return placed.select("doc_id", "source", F.format_string("%06d.txt", F.col("place") - 1).alias("name"))


@query("p07_eligible_runs", with_views("phases") + "SELECT run_id FROM phases GROUP BY 1 HAVING arg_max(status, ord) IN ('succeeded', 'partially_failed')")
def eligible(s, d):
    return phases(s, d).groupBy("run_id").agg(F.max_by("status", "ord").alias("status")).where(F.col("status").isin("succeeded", "partially_failed")).select("run_id")


@query("p08_active_rows", with_views("phases") + "SELECT run_id, phase, shard_id, CAST(round_even(current * 100.0::DOUBLE / total, 0) AS INTEGER) AS percent, ord FROM phases WHERE status IN ('running', 'paused')")
def active(s, d):
    return phases(s, d).where(F.col("status").isin("running", "paused")).select("run_id", "phase", "shard_id", P.percent(F.col("current"), F.col("total")).alias("percent"), "ord")


@query("p17_placeholder_notes", "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '\\s+', ' ', 'g')) > 200 AND NOT contains(text, 'License') AND NOT contains(text, 'www')")
def notes(s, d):
    text = F.col("text")
    return table(s, d, "documents").where((F.length(F.regexp_replace(text, r"\s+", " ")) > 200) & ~text.contains("License") & ~text.contains("www")).select("doc_id")


@query("j11_label_map", """SELECT c_custkey, coalesce(r1.r_name, r2.r_name, c_mktsegment) AS label FROM customer LEFT JOIN region r1 ON r1.r_regionkey = c_custkey % 9 LEFT JOIN region r2 ON r2.r_regionkey = c_custkey % 6""")
def label_map(s, d):
    region, c = F.broadcast(table(s, d, "region")), table(s, d, "customer")
    one, two = region.select(F.col("r_regionkey").alias("k1"), F.col("r_name").alias("l1")), region.select(F.col("r_regionkey").alias("k2"), F.col("r_name").alias("l2"))
    both = c.join(F.broadcast(one), F.col("c_custkey") % 9 == F.col("k1"), "left").join(F.broadcast(two), F.col("c_custkey") % 6 == F.col("k2"), "left")
    return both.select("c_custkey", F.coalesce("l1", "l2", "c_mktsegment").alias("label"))


@query("j20_enriched_catalog", """WITH uses AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1), installed AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity > 40)
SELECT p_partkey, coalesce(uses.n, 0) AS uses, installed.part IS NOT NULL AS installed, uses.n IS NOT NULL AND installed.part IS NULL AS downloadable FROM part LEFT JOIN uses ON uses.part = p_partkey LEFT JOIN installed ON installed.part = p_partkey""")
def enriched(s, d):
    line = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    uses = line.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_quantity") > 40).alias("i"))
    installed = F.coalesce("i", F.lit(False))
    return table(s, d, "part").select("p_partkey").join(uses, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("uses"), installed.alias("installed"), (F.col("n").isNotNull() & ~installed).alias("downloadable"))


@query("a09_detection_score", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (n_chars % 100) / 100 ELSE CASE WHEN substr(b, 1, 1) = '1' THEN 1.0 ELSE 0.0 END END AS score FROM (SELECT doc_id, n_chars, bin(n_chars) AS b FROM documents WHERE n_chars > 0)""")
def detection_score(s, d):
    docs = table(s, d, "documents").where("n_chars > 0")
    explicit = F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 100) / 100)
    return docs.select("doc_id", F.coalesce(explicit, C.bit_accuracy(F.lit("1"), F.bin("n_chars"))).alias("score"))


@query("a11_cell_degradation", with_views("blocks") + """SELECT label, round(avg(least(1, greatest(0, 1 - psnr / 50))), 4) AS nqd FROM (
  SELECT vec_id, CASE WHEN e > 0 THEN 10 * log10(65025.0::DOUBLE / e) ELSE 50 END AS psnr FROM (SELECT vec_id, list_avg(list_transform(px, lambda v: (CAST(least(255, greatest(0, floor(v * 1.4::DOUBLE + 0.5))) AS INTEGER) - v) ** 2)) AS e FROM blocks)) JOIN embeddings USING (vec_id) GROUP BY 1""")
def degradation(s, d):
    own = blocks(s, d).select("vec_id", F.coalesce(X.psnr(F.col("px"), X.brightness(F.col("px"), 1.4)), F.lit(50.0)).alias("psnr"))
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("psnr") / 50))
    return own.join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.round(F.avg(clipped), 4).alias("nqd"))


@query("a12_clean_fidelity", with_views("cells") + "SELECT algorithm_id, round(1 - avg(nqd), 6) AS clean_fidelity FROM cells WHERE strength = 0 GROUP BY 1")
def clean_fidelity(s, d):
    return cells(s, d).where("strength = 0").groupBy("algorithm_id").agg(F.round(1 - F.avg("nqd"), 6).alias("clean_fidelity"))


@query("a30_phase_status", with_views("phases") + """SELECT run_id, phase, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'pending' END AS status FROM phases GROUP BY 1, 2""")
def phase_status(s, d):
    return phases(s, d).groupBy("run_id", "phase").agg(P.lattice().alias("status"))


@query("a34_percent", with_views("phases") + "SELECT ord, CAST(greatest(0, least(100, round_even(current * 100.0::DOUBLE / (total - 20), 0))) AS INTEGER) AS percent FROM phases")
def percents(s, d):
    return phases(s, d).select("ord", P.percent(F.col("current"), F.col("total") - 20).alias("percent"))


@query("a35_cell_progress", with_views("phases") + "SELECT run_id, CAST(sum(coalesce(nullif(current, 0), phase)) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total FROM phases GROUP BY 1")
def cell_progress(s, d):
    return phases(s, d).groupBy("run_id").agg(F.sum(F.coalesce(F.nullif("current", F.lit(0)), F.col("phase").cast("long"))).alias("done"), F.sum("total").alias("total"))


@query("w01_dense_position", with_views("detections") + "SELECT cell_key, doc_id, CAST(row_number() OVER (PARTITION BY cell_key ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM detections")
def dense_position(s, d):
    return detections(s, d).select("cell_key", "doc_id", F.row_number().over(Window.partitionBy("cell_key").orderBy(F.col("score").desc(), "doc_id")).alias("place"))


@query("w03_relative_to_max", with_views("cells") + "SELECT category, algorithm_id, round(greatest(3, m / greatest(1, max(m) OVER (PARTITION BY category)) * 100), 4) AS bar FROM (SELECT category, algorithm_id, avg(tpr) * 100 AS m FROM cells GROUP BY 1, 2)")
def relative_to_max(s, d):
    own = cells(s, d).groupBy("category", "algorithm_id").agg((F.avg("tpr") * 100).alias("m"))
    top = F.greatest(F.lit(1.0), F.max("m").over(Window.partitionBy("category")))
    return own.select("category", "algorithm_id", F.round(F.greatest(F.lit(3.0), F.col("m") / top * 100), 4).alias("bar"))


@query("o02_catalog_order", "SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS stage_order FROM part")
def catalog_order(s, d):
    order = F.broadcast(s.createDataFrame([(1, 0), (3, 1), (2, 2), (0, 3)], "k int, stage_order int"))
    return table(s, d, "part").join(order, F.col("p_size") % 4 == F.col("k")).select("p_partkey", "stage_order")


@query("o05_shuffled_take", "SELECT c_custkey FROM customer ORDER BY md5('11:' || c_custkey), c_custkey LIMIT 30")
def shuffled(s, d):
    return R.hash_sample(table(s, d, "customer").select("c_custkey"), "c_custkey", 11, 30)


@query("f06_shard_key", "SELECT o_orderkey, 'shard' || (o_orderkey % 8) || '__' || regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]', '_', 'g') AS key FROM orders")
def shard_key(s, d):
    return table(s, d, "orders").select("o_orderkey", S.cell_key(F.concat(F.lit("shard"), F.col("o_orderkey") % 8), S.safe_segment(F.col("o_orderpriority"))).alias("key"))


@query("f07_viewpoint_method", "SELECT p_partkey, ['swipe', 'shake', 'rotate', 'rotate_forward'][1 + p_partkey % 4] AS motion, ['point', 'ahead'][1 + p_partkey % 2] AS look_at FROM part")
def viewpoint(s, d):
    motion = F.element_at(F.array(*[F.lit(m) for m in ("swipe", "shake", "rotate", "rotate_forward")]), (1 + F.col("p_partkey") % 4).cast("int"))
    method = F.concat_ws("_", motion, F.element_at(F.array(F.lit("point"), F.lit("ahead")), (1 + F.col("p_partkey") % 2).cast("int")))
    parts = r"^(swipe|shake|rotate_forward|rotate)_(point|ahead)$"
    return table(s, d, "part").select("p_partkey", F.regexp_extract(method, parts, 1).alias("motion"), F.regexp_extract(method, parts, 2).alias("look_at"))


@query("f12_display_name", "SELECT p_partkey, upper(substr(replace(lower(p_brand), '#', ' '), 1, 1)) || substr(replace(lower(p_brand), '#', ' '), 2) AS name FROM part")
def display_name(s, d):
    return table(s, d, "part").select("p_partkey", F.initcap(F.regexp_replace("p_brand", "#", " ")).alias("name"))


@query("f14_size_parser", "SELECT p_partkey, p_size AS width, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS height FROM part")
def size_parser(s, d):
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("["), F.col("p_size"), F.lit(","), F.col("p_size") + 1, F.lit("]")))
    own = table(s, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", F.from_json("t", "array<int>").alias("l"), F.col("t").try_cast("int").alias("n"))
    return own.select("p_partkey", F.coalesce(F.get("l", F.lit(0)), "n").alias("width"), F.coalesce(F.get("l", F.lit(1)), "n").alias("height"))


@query("f15_first_alias", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.kk') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS v FROM events")
def first_alias(s, d):
    found = [F.get_json_object("props", p).cast("long") for p in ("$.kk", "$.k")]
    return table(s, d, "events").select("event_id", F.coalesce(*found, F.lit(0)).alias("v"))


@query("f18_badges", with_views("profile") + "SELECT event_id, CASE status WHEN 'succeeded' THEN 'ok' WHEN 'failed' THEN 'error' ELSE status END || ' ' || printf('%d', k) AS badge FROM profile")
def badges(s, d):
    word = F.when(F.col("status") == "succeeded", "ok").when(F.col("status") == "failed", "error").otherwise(F.col("status"))
    return profile(s, d).select("event_id", F.format_string("%s %d", word, F.col("k")).alias("badge"))


@query("m07_size_change", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size > 25 THEN 'shrunk' WHEN p_size = 25 THEN 'same' ELSE 'grown' END AS change FROM part")
def size_change(s, d):
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", F.when(size % 7 == 0, "unknown").when(size > 25, "shrunk").when(size == 25, "same").otherwise("grown").alias("change"))


@query("m09_distance_scale", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.6, greatest(0.65, l_quantity / 25)), 6) AS scale FROM lineitem")
def distance_scale(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.least(F.lit(1.6), F.greatest(F.lit(0.65), F.col("l_quantity") / 25)), 6).alias("scale"))


@query("m13_point_radius", "SELECT event_id, round(3 + 5 * least(1, value / 100), 6) AS radius FROM events")
def radius(s, d):
    return table(s, d, "events").select("event_id", F.round(3 + 5 * F.least(F.lit(1.0), F.col("value") / 100), 6).alias("radius"))


@query("x29_bits_string", "SELECT doc_id, bin(n_chars) AS bits, length(replace(bin(n_chars), '0', '')) AS ones FROM documents")
def bits_string(s, d):
    bits = F.filter(F.split(F.bin("n_chars"), ""), lambda b: b != "")
    return table(s, d, "documents").select("doc_id", F.array_join(bits, "").alias("bits"), F.size(F.filter(bits, lambda b: b == "1")).cast("long").alias("ones"))


@query("c02_strength_injected", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'scale=' || (p_size // 10) WHEN p_size % 3 = 1 THEN 'strength=' || (p_size / 10) ELSE '' END AS params FROM part")
def injected(s, d):
    size = F.col("p_size")
    value = F.when(size % 3 == 0, F.concat(F.lit("scale="), F.floor(size / 10))).when(size % 3 == 1, F.concat(F.lit("strength="), size / 10)).otherwise("")
    return table(s, d, "part").select("p_partkey", value.alias("params"))


@query("c11_readiness_report", with_views("profile") + """SELECT 'workers' AS name, CASE WHEN count(DISTINCT device) >= 10 THEN 'ok' ELSE 'error' END AS state FROM profile UNION ALL
SELECT 'failures', CASE WHEN avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0 END) < 0.5 THEN 'ok' ELSE 'error' END FROM profile""")
def readiness_report(s, d):
    own = profile(s, d).agg(F.countDistinct("device").alias("w"), F.avg((F.col("status") == "failed").cast("double")).alias("f"))
    workers = F.struct(F.lit("workers").alias("name"), F.when(F.col("w") >= 10, "ok").otherwise("error").alias("state"))
    failures = F.struct(F.lit("failures").alias("name"), F.when(F.col("f") < 0.5, "ok").otherwise("error").alias("state"))
    return own.select(F.explode(F.array(workers, failures)).alias("r")).select("r.*")


@query("t07_last_write_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_write(s, d):
    own = table(s, d, "events").withColumn("ord", F.struct("ts", "event_id"))
    return R.latest(own, "user_id", "ord").select("user_id", "event_type", "value")


@query("m11_axis_ticks", "SELECT p_partkey, CAST(pow(10, floor(log10(p_size + 1))) AS BIGINT) AS step, CAST(ceil((p_size + 1) / pow(10, floor(log10(p_size + 1)))) AS BIGINT) AS ticks FROM part")
def ticks(s, d):
    top = F.col("p_size") + 1
    step = F.pow(F.lit(10.0), F.floor(F.log10(top)))
    return table(s, d, "part").select("p_partkey", step.cast("long").alias("step"), F.ceil(top / step).alias("ticks"))
