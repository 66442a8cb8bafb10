"""Registered queries: rules of plans, readiness and parent runs, on data that meets every case of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustlake.operators import planning as P
from robustlake.operators import records as R
from robustlake.operators import scoring as C
from robustlake.plans.bindings import cells, table, with_views
from robustlake.plans.registry import query
from robustlake.sources import writers
from robustlake.storage import scratch
from robustlake.streaming import heartbeats as H
from robustlake.streaming import series as Z
from robustlake.streaming.live import stage_windows

METHODS = [f"3d_viewpoint_rerendering_{m}_{a}" for m in ("swipe", "shake", "rotate", "rotate_forward") for a in ("point", "ahead")]
METHODS += ["3d_viewpoint_rerendering_swipe_v2_point", "identity", "jpeg", "rotation", "rotate", "swipe_ahead"]
PICK = f"{METHODS!r}[CAST(1 + {{}} % {len(METHODS)} AS INTEGER)]"
SQL_MOTION = f"nullif(regexp_extract(method, '{P.MOTION}', 1), '')"


def method_of(key):
    return F.element_at(F.array(*[F.lit(m) for m in METHODS]), (1 + key % len(METHODS)).cast("int"))


@query("a42_distinct_attacks", f"""WITH m AS (SELECT l_suppkey, l_linenumber, {PICK.format("(l_partkey + l_orderkey)")} AS method FROM lineitem)
SELECT l_suppkey, l_linenumber, count(DISTINCT coalesce('motion:' || {SQL_MOTION}, method)) FILTER (WHERE method <> 'identity') AS n_attacks FROM m GROUP BY 1, 2""")
def distinct_attacks(s, d):
    own = table(s, d, "lineitem").select("l_suppkey", "l_linenumber", method_of(F.col("l_partkey") + F.col("l_orderkey")).alias("method"))
    return own.groupBy("l_suppkey", "l_linenumber").agg(F.countDistinct(P.attack_type(F.col("method"))).alias("n_attacks"))


@query("w19_first_of_motion", f"""WITH m AS (SELECT p_partkey, p_name, {PICK.format("p_partkey")} AS method FROM part), n AS (SELECT *, {SQL_MOTION} AS motion FROM m)
SELECT '3d_viewpoint_rerendering_' || motion AS alias, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name, arg_min(method, p_partkey) AS method FROM n WHERE motion IS NOT NULL GROUP BY motion""")
def first_of_motion(s, d):
    return P.alias_rows(table(s, d, "part").select("p_partkey", "p_name", method_of(F.col("p_partkey")).alias("method")), "method", "p_partkey")


@query("c05_identity_baseline", """WITH a AS (SELECT DISTINCT p_brand AS config, CASE WHEN p_partkey % 90 = 0 THEN 'identity' ELSE p_type END AS attack FROM part),
e AS (SELECT config, attack, false AS hidden FROM a UNION ALL SELECT DISTINCT config, 'identity', true FROM a), b AS (SELECT config, attack, bool_and(hidden) AS hidden FROM e GROUP BY 1, 2)
SELECT config, count(*) AS n_attacks, bool_or(hidden) AS hidden_baseline, CAST(sum(CASE attack WHEN 'identity' THEN 1 ELSE 3 END) AS BIGINT) AS n_cells FROM b GROUP BY 1""")
def baseline(s, d):
    """Three variants of each attack, one of the identity, which is there whether asked for or not."""
    attack = F.when(F.col("p_partkey") % 90 == 0, "identity").otherwise(F.col("p_type"))
    every = P.with_baseline(table(s, d, "part").select(F.col("p_brand").alias("config"), attack.alias("attack")), "config", "attack")
    cells = F.when(F.col("attack") == "identity", 1).otherwise(3)
    return every.groupBy("config").agg(F.count(F.lit(1)).alias("n_attacks"), F.bool_or("hidden").alias("hidden_baseline"), F.sum(cells).alias("n_cells"))


@query("c06_unknown_ids", """WITH a AS (SELECT DISTINCT l_orderkey AS config, CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey + 60 ELSE l_suppkey END AS supplier FROM lineitem)
SELECT config, count(*) AS asked, count(*) FILTER (WHERE s_suppkey IS NULL) AS unknown,
  coalesce(array_to_string(list_slice(list_sort(list(supplier) FILTER (WHERE s_suppkey IS NULL)), 1, 3), ', '), '') AS names FROM a LEFT JOIN supplier ON s_suppkey = supplier GROUP BY 1""")
def unknown_ids(s, d):
    supplier = F.when(F.col("l_orderkey") % 4 == 0, F.col("l_suppkey") + 60).otherwise(F.col("l_suppkey")).alias("supplier")
    asked = table(s, d, "lineitem").select(F.col("l_orderkey").alias("config"), supplier)
    return P.checked(asked, table(s, d, "supplier").select(F.col("s_suppkey").alias("supplier")), "config", "supplier")


@query("s10_pack_ready", """WITH q AS (SELECT DISTINCT p_brand AS pack, p_size % 4 AS marker FROM part), h AS (SELECT DISTINCT p_brand AS pack, p_size % 4 AS marker FROM part WHERE p_partkey % 3 = 0)
SELECT pack, count(*) AS files, count(*) FILTER (WHERE h.marker IS NULL) AS missing, count(*) FILTER (WHERE h.marker IS NULL) = 0 AS ready FROM q LEFT JOIN h USING (pack, marker) GROUP BY 1""")
def pack_ready(s, d):
    """Marker files of packs, of which a third of the parts have brought theirs, against a listing of the folder."""
    own = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("pack"), (F.col("p_size") % 4).alias("marker"))
    folder = scratch(s, "packs")
    there = own.where("p_partkey % 3 = 0").select("pack", "marker", F.col("marker").alias("bytes")).distinct()
    there.repartition("pack", "marker").write.partitionBy("pack", "marker").parquet(folder.path)
    listed = P.files_below(s, folder.path).select(F.url_decode(F.regexp_replace("path", "/[^/]*$", "")).alias("path"), "length")
    required = own.select("pack", F.concat(F.lit("pack="), "pack", F.lit("/marker="), "marker").alias("path"))
    return P.packs_ready(required, listed)


@query("p13_manifest_match", """WITH w AS (SELECT doc_id, 'img/' || doc_id || '.png' AS rel, coalesce(n_chars, 0) AS size, doc_id * 1000 AS mtime, doc_id % 13 AS c FROM documents WHERE doc_id IS NOT NULL)
SELECT rel AS source_relative, CASE c WHEN 0 THEN '' WHEN 1 THEN 'source_relative,source_size,source_mtime_ns,output_path,metadata.preprocess_policy,metadata.canonical_size,preprocess_policy,canonical_size,output_policy'
  WHEN 2 THEN 'source_size' WHEN 3 THEN 'source_mtime_ns' WHEN 4 THEN 'output_path' WHEN 5 THEN 'metadata.preprocess_policy' WHEN 6 THEN 'metadata.canonical_size' WHEN 7 THEN 'preprocess_policy'
  WHEN 8 THEN 'canonical_size' WHEN 9 THEN 'output_policy' WHEN 10 THEN 'file' WHEN 11 THEN 'metadata.preprocess_policy,metadata.canonical_size' ELSE 'source_size,file' END AS differs FROM w""")
def manifest_match(s, d):
    """A manifest of which each thirteenth record is right and every other one is wrong in a way of its own."""
    own = table(s, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("source_size"), (F.col("doc_id") % 13).alias("c"))
    rel, out = F.concat(F.lit("img/"), "doc_id", F.lit(".png")), F.concat(F.lit("out/"), "doc_id", F.lit(".png"))
    wanted = own.select(rel.alias("source_relative"), "source_size", (F.col("doc_id") * 1000).alias("source_mtime_ns"), out.alias("output_path"), "c")
    wrong = lambda *cases: F.col("c").isin(*cases)
    size = lambda case: F.when(wrong(case), F.array(F.lit(512))).otherwise(F.array(F.lit(512), F.lit(512)))
    policy = lambda case: F.when(wrong(case), "stretch").otherwise(P.PREPROCESS)
    records = wanted.where(~wrong(1)).select(
        "source_relative", F.when(wrong(2, 12), F.col("source_size") + 1).otherwise(F.col("source_size")).alias("source_size"),
        F.when(wrong(3), F.lit(None)).otherwise(F.col("source_mtime_ns")).alias("source_mtime_ns"), F.when(wrong(4), "out/other.png").otherwise(F.col("output_path")).alias("output_path"),
        F.when(~wrong(11), F.struct(policy(5).alias("preprocess_policy"), size(6).alias("canonical_size"))).alias("metadata"),
        policy(7).alias("preprocess_policy"), size(8).alias("canonical_size"), F.when(wrong(9), "jpeg").otherwise(P.OUTPUT).alias("output_policy"),
    )
    return P.manifest_matches(records, wanted, wanted.where(~wrong(10, 12)).select(F.col("output_path").alias("path")))


@query("a31_run_status", """WITH o AS (SELECT *, o_orderkey // 2 AS k FROM orders),
s AS (SELECT o_custkey AS run_id, bool_or(k % 41 = 0) AS cancelled, bool_or(k % 43 = 0) AS paused, count(*) FILTER (WHERE k % 23 = 0) AS errors,
  CAST(sum(CASE WHEN k % 3 <> 0 OR k % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS expected,
  count(*) FILTER (WHERE k % 3 <> 0) AS units, count(*) FILTER (WHERE k % 3 <> 0 AND o_orderstatus = 'O' AND o_custkey % 2 = 0) AS failed FROM o GROUP BY 1)
SELECT run_id, CASE WHEN cancelled THEN 'cancelled' WHEN paused THEN 'paused' WHEN errors > 0 OR expected > 0 AND units < expected THEN CASE WHEN units > 0 THEN 'partially_failed' ELSE 'failed' END
  WHEN failed = 0 THEN 'succeeded' WHEN failed < units THEN 'partially_failed' ELSE 'failed' END AS status FROM s""")
def run_status(s, d):
    """An order is a shard of its customer's run; two thirds of the orders have a result."""
    own = table(s, d, "orders").select(F.col("o_custkey").alias("run_id"), F.floor(F.col("o_orderkey") / 2).alias("k"), "o_orderstatus")
    k = F.col("k")
    shards = own.select(
        "run_id", F.when(k % 41 == 0, "cancelled").when(k % 43 == 0, "paused").otherwise("succeeded").alias("status"),
        F.when((k % 3 != 0) | (k % 13 == 0), 1).otherwise(0).alias("expected"), F.when(k % 23 == 0, "lost").alias("error"),
    )
    failed = (F.col("o_orderstatus") == "O") & (F.col("run_id") % 2 == 0)
    return P.parent_status(shards, own.where(k % 3 != 0).select("run_id", F.when(failed, "failed").otherwise("succeeded").alias("status")))


@query("p04_selection_defaults", """SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN p_brand || '|' || p_type ELSE 'first' END AS datasets,
  CASE WHEN p_size % 7 IN (0, 1, 5) THEN 1 WHEN p_size % 7 = 2 THEN 2 WHEN p_size % 7 = 6 THEN 6 ELSE p_size END AS max_samples, CASE p_size % 3 WHEN 0 THEN '42' WHEN 1 THEN '7' ELSE '1|' || p_size END AS seeds FROM part""")
def selection(s, d):
    """Selection documents with members missing, null, zero, negative or as texts."""
    size = F.col("p_size")
    ids = F.when(size % 4 < 2, F.concat(F.lit('"datasetIds": ["'), "p_brand", F.lit('", "'), "p_type", F.lit('"], '))).when(size % 4 == 2, '"datasetIds": [], ').otherwise("")
    samples = F.when(size % 7 == 0, "").when(size % 7 == 1, '"maxSamples": null, ').when(size % 7 == 2, '"maxSamples": "2", ').when(size % 7 == 5, '"maxSamples": -5, ')
    samples = samples.when(size % 7 == 6, '"maxSamples": 6.9, ').otherwise(F.concat(F.lit('"maxSamples": '), size, F.lit(", ")))
    seeds = F.when(size % 3 == 0, '"seeds": []').when(size % 3 == 1, '"seeds": [7]').otherwise(F.concat(F.lit('"seeds": [1, '), size, F.lit("]")))
    found = P.selection(F.concat(F.lit("{"), ids, samples, seeds, F.lit("}")), F.array(F.lit("first"), F.lit("second")))
    own = table(s, d, "part").select("p_partkey", found.alias("x"))
    return own.select("p_partkey", F.array_join("x.dataset_ids", "|").alias("datasets"), "x.max_samples", F.array_join(F.transform("x.seeds", lambda v: v.cast("string")), "|").alias("seeds"))


@query("j13_marker_in_use", """WITH m AS (SELECT DISTINCT p_brand AS pack, p_size AS marker, p_partkey % 5 <> 0 AS installed FROM part), i AS (SELECT DISTINCT pack, marker FROM m WHERE installed)
SELECT m.pack, m.marker, count(DISTINCT i.pack) FILTER (WHERE i.pack <> m.pack) AS others FROM (SELECT DISTINCT pack, marker FROM m) m LEFT JOIN i USING (marker) GROUP BY 1, 2""")
def marker_in_use(s, d):
    """For each marker of a pack how many other installed packs use it: none, and it may be deleted with the pack."""
    own = table(s, d, "part").select(F.col("p_brand").alias("pack"), F.col("p_size").alias("marker"), (F.col("p_partkey") % 5 != 0).alias("installed"))
    held = own.groupBy("pack", "marker").agg(F.bool_or("installed").alias("installed"))
    users = held.where("installed").groupBy("marker").agg(F.count(F.lit(1)).alias("users"))
    others = F.coalesce("users", F.lit(0)) - F.col("installed").cast("long")
    return held.join(users, "marker", "left").select("pack", "marker", others.alias("others"))


@query("j14_reconcile", """WITH ready AS (SELECT DISTINCT l_partkey AS pack FROM lineitem WHERE l_quantity > 49 OR l_partkey % 7 = 0), marked AS (SELECT DISTINCT l_partkey AS pack FROM lineitem WHERE l_quantity < 3 OR l_partkey % 7 = 0)
SELECT coalesce(ready.pack, marked.pack) AS pack, CASE WHEN marked.pack IS NULL THEN 'added' ELSE 'removed' END AS change
FROM ready FULL JOIN marked ON ready.pack = marked.pack WHERE ready.pack IS NULL OR marked.pack IS NULL""")
def reconcile(s, d):
    """Packs whose files are there against packs that are marked as installed; every seventh is both."""
    rows = table(s, d, "lineitem").select(F.col("l_partkey").alias("pack"), "l_quantity")
    return R.reconciled(rows.where("l_quantity > 49 OR pack % 7 = 0"), rows.where("l_quantity < 3 OR pack % 7 = 0"), "pack")


@query("p18_system_healthy", with_views("profile") + "SELECT batch, NOT bool_or(status = 'failed' AND stage = 'error') AS healthy, count(DISTINCT device) AS workers FROM profile GROUP BY 1")
def system_healthy(s, d):
    from robustlake.plans.bindings import profile

    bad = (F.col("status") == "failed") & (F.col("stage") == "error")
    return profile(s, d).groupBy("batch").agg((~F.bool_or(bad)).alias("healthy"), F.countDistinct("device").alias("workers"))


@query("t01_stage_windows", """SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def windows(s, d):
    """Windows of a stream over the event log, whose rows come up to two hours late, as its last state has them."""
    rows = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    late = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7200).otherwise(0)
    source, out = H.arriving(rows, F.unix_micros("ts") + late * 1_000_000, 3, "event-log"), scratch(s, "windows")
    log = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source.path)
    found = stage_windows(log, "3 hours").select("event_type", F.col("window.start").alias("start"), "n", "mean")

    def keep(batch, number):
        H.keep_latest(batch.withColumns({"id": F.concat_ws("|", "event_type", F.col("start").cast("string")), "batch_number": F.lit(number).cast("long")}), number, f"{out.path}/rows", "id", "batch_number")

    found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out.path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = found.schema.add("id", "string").add("batch_number", "long")
    return H.latest_table(s, f"{out.path}/rows", schema).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("t06_stream_state", """WITH RECURSIVE s AS (SELECT user_id, ts, event_id, value, row_number() OVER w AS k, lag(value) OVER w AS pv, lag(ts) OVER w AS pt,
  list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS l, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ring
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, k, value AS ema FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, round_even((r.ema * 0.55::DOUBLE + s.value * (1 - 0.55::DOUBLE)) * 100, 0) / 100 FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT s.user_id, s.event_id, r.ema, l[len(l) // 2 + 1] AS median, round(CASE WHEN ts > pt THEN greatest(0, (value - pv) / ((epoch_us(ts) - epoch_us(pt)) / 1000000)) END, 9) AS rate, round(ring, 6) AS ring_mean
FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""")
def stream_state(s, d):
    """Averages, medians, rates and rings of a stream whose rows come up to two hours late: those that the watermark has passed."""
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    late = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7200).otherwise(0)
    source = H.arriving(rows, F.unix_micros("ts") + late * 1_000_000, 3, "samples")
    found = Z.replayed_series(s, source, rows.schema, "3 hours", ring=20)
    return found.select(F.col("key").alias("user_id"), "event_id", "ema", "median", F.round("rate", 9).alias("rate"), F.round("ring_mean", 6).alias("ring_mean"))


@query("s05_dataset_discovery", """WITH catalog AS (SELECT DISTINCT n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0),
found AS (SELECT n_name AS name, count(*) FILTER (WHERE c_custkey % 37 = 0) AS images FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT name, true AS listed, coalesce(images, 0) AS images FROM catalog LEFT JOIN found USING (name)
UNION ALL SELECT name, false, images FROM found WHERE images > 0 AND name NOT IN (SELECT name FROM catalog)""")
def dataset_discovery(s, d):
    """Listed datasets, with or without images, and folders that are not listed but hold one."""
    nation = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    even = table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    catalog = nation.join(even, "n_nationkey", "left_semi").select("name").distinct()
    customers = table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 37 == 0).alias("image"))
    folders = customers.groupBy("n_nationkey").agg(F.count_if("image").alias("images")).join(nation, "n_nationkey").select("name", "images")
    return P.discovered(catalog, folders)


IMAGE = "CASE WHEN page_id % 5 = 0 THEN 'p' || page_id || '.png' ELSE 'set' || page_id % 3 || '/' || CASE WHEN page_id % 2 = 0 THEN 'sub/' ELSE '' END || page_id || '.png' END"


@query("s07_depth_zero", f"""WITH i AS (SELECT {IMAGE} AS path FROM pages)
SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'local-root' END AS dataset, count(*) AS images, max(path) AS last FROM i GROUP BY 1""")
def depth_zero(s, d):
    """Images right below the root are a dataset of their own; the others belong to the folder that they are in."""
    return P.folder_datasets(table(s, d, "pages").select(F.expr(IMAGE).alias("path")))


@query("j07_reference_target", """WITH l AS (SELECT l_orderkey, l_orderkey || '/' || l_linenumber || '.png' AS rel, l_partkey FROM lineitem),
r AS (SELECT DISTINCT l_orderkey, rel FROM l WHERE l_partkey % 5 <> 0), t AS (SELECT DISTINCT l_orderkey, rel FROM l WHERE l_partkey % 7 <> 0)
SELECT coalesce(r.l_orderkey, t.l_orderkey) AS cell, count(*) FILTER (WHERE r.rel IS NOT NULL AND t.rel IS NOT NULL) AS pairs, count(*) FILTER (WHERE t.rel IS NULL) AS no_target, count(*) FILTER (WHERE r.rel IS NULL) AS no_reference
FROM r FULL JOIN t ON r.l_orderkey = t.l_orderkey AND r.rel = t.rel GROUP BY 1""")
def reference_target(s, d):
    """Reference images against those that a step made of them, by the path below the folder of each."""
    rel = F.concat(F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"), F.lit(".png"))
    own = table(s, d, "lineitem").select(F.col("l_orderkey").alias("cell"), rel.alias("rel"), "l_partkey")
    below = lambda folder, step: own.where(F.col("l_partkey") % step != 0).select("cell", F.concat(F.lit(folder), "rel").alias("path"))
    pairs = P.paired(below("/runs/1/canonical/", 5), below("/runs/1/attacked/", 7), "cell", "/runs/1/canonical/", "/runs/1/attacked/")
    there = lambda c: F.col(c).isNotNull()
    return pairs.groupBy("cell").agg(F.count_if(there("reference") & there("target")).alias("pairs"), F.count_if(~there("target")).alias("no_target"), F.count_if(~there("reference")).alias("no_reference"))


@query("a04_known_estimate", """WITH a AS (SELECT c_custkey % 50 AS config, c_nationkey + c_custkey % 7 AS dataset, c_mktsegment AS algorithm FROM customer),
k AS (SELECT config, count(DISTINCT n_nationkey) AS known, count(DISTINCT dataset) AS asked, count(DISTINCT algorithm) AS algorithms FROM a LEFT JOIN nation ON n_nationkey = dataset GROUP BY 1)
SELECT config, asked, known, known * algorithms * 6 AS n_cells, known * algorithms * 6 * greatest(1, config) AS n_ops, CASE WHEN known * algorithms * 6 > 64 OR known * algorithms * 6 * greatest(1, config) > 10000 THEN 'warn' ELSE 'ok' END AS level FROM k""")
def known_estimate(s, d):
    """Cells and operations of configurations that ask for some datasets which there are not; six attack variants, as many samples as the number of the configuration."""
    asked = table(s, d, "customer").select((F.col("c_custkey") % 50).alias("config"), (F.col("c_nationkey") + F.col("c_custkey") % 7).alias("dataset"), F.col("c_mktsegment").alias("algorithm"))
    return P.known_estimate(asked, table(s, d, "nation").select(F.col("n_nationkey").alias("dataset")), 6, F.greatest(F.lit(1), F.col("config")))


@query("x31_alignment", """WITH t AS (SELECT p_partkey, p_size AS w, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size + 1 END AS h, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS tw,
  CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL ELSE p_size + 1 END AS th FROM part)
SELECT p_partkey, CASE WHEN w IS NOT DISTINCT FROM tw AND h IS NOT DISTINCT FROM th THEN 'none' ELSE 'resize_target' END AS policy FROM t""")
def alignment(s, d):
    """A target is resized only if its size is not that of the reference; unknown sides are equal only to unknown ones."""
    key, size = F.col("p_partkey"), F.col("p_size")
    h = F.when(key % 11 != 0, size + 1)
    sizes = table(s, d, "part").select("p_partkey", F.struct(size.alias("w"), h.alias("h")).alias("own"), F.struct(F.when(key % 3 == 0, size + 1).otherwise(size).alias("w"), F.when(key % 13 != 0, h).alias("h")).alias("target"))
    same = F.col("own.w").eqNullSafe(F.col("target.w")) & F.col("own.h").eqNullSafe(F.col("target.h"))
    return sizes.select("p_partkey", F.when(same, "none").otherwise("resize_target").alias("policy"))


@query("k02_document", with_views("cells") + "SELECT count(*) AS n_cells, count(DISTINCT algorithm_id) AS algorithms, max(samples) AS most, 'é' || chr(34) || chr(10) AS note FROM cells")
def document(s, d):
    """A summary written as one JSON document, and again over it, as it reads."""
    own = cells(s, d).agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("algorithm_id").alias("algorithms"), F.max("samples").alias("most"), F.lit('é"\n').alias("note"))
    path = f"{scratch(s, 'document').path}/summary"
    writers.write_document(own.withColumn("n_cells", F.lit(0).cast("long")), path)
    writers.write_document(own, path)
    return s.read.schema(own.schema).json(path)


@query("a21_fidelity", with_views("cells") + """, m AS (SELECT algorithm_id, 1 - avg(nqd) AS clean FROM cells GROUP BY 1)
SELECT algorithm_id, round(CASE WHEN max(clean) OVER () <= min(clean) OVER () THEN 1 ELSE (clean - min(clean) OVER ()) / (max(clean) OVER () - min(clean) OVER ()) END, 6) AS fidelity FROM m""")
def fidelity(s, d):
    own = cells(s, d).groupBy("algorithm_id").agg((1 - F.avg("nqd")).alias("clean"))  # a row for each algorithm
    return own.select("algorithm_id", F.round(C.min_max(F.col("clean")), 6).alias("fidelity"))


@query("a22_simplicity", with_views("profile") + """, m AS (SELECT device, sum(elapsed_ms) - 1500 AS ms FROM profile GROUP BY 1), l AS (SELECT device, CASE WHEN ms > 0 THEN ln(1 + ms) END AS x FROM m)
SELECT device, round(1 - CASE WHEN max(x) OVER () <= min(x) OVER () THEN CASE WHEN x IS NOT NULL THEN 1 END ELSE (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END, 6) AS simplicity FROM l""")
def simplicity(s, d):
    """The shorter a runtime among its peers, the simpler; times that are not above zero have none."""
    from robustlake.plans.bindings import profile

    own = profile(s, d).groupBy("device").agg((F.sum("elapsed_ms") - 1500).alias("ms"))
    return own.select("device", F.round(1 - C.min_max(F.when(F.col("ms") > 0, F.log1p("ms"))), 6).alias("simplicity"))


POINTS = """p AS (SELECT algorithm_id, category, strength, sum(tpr * w) / sum(w) AS tpr, sum(nqd * w) / sum(w) AS nqd FROM (SELECT *, CASE WHEN samples > 0 THEN samples ELSE 1 END::DOUBLE AS w FROM cells) GROUP BY 1, 2, 3)"""


@query("w04_segments", with_views("cells") + f""", {POINTS}, g AS (SELECT *, lag(strength) OVER w AS px, lag(tpr) OVER w AS py FROM p WINDOW w AS (PARTITION BY algorithm_id, category ORDER BY strength))
SELECT algorithm_id, category, px AS x0, strength AS x1, round((strength - px) * (tpr + py) / 2, 9) AS area FROM g WHERE px IS NOT NULL""")
def segments(s, d):
    points = C.curve_points(cells(s, d), "algorithm_id", "category", "strength")
    found = C.segments(points, ["algorithm_id", "category"], "strength", "tpr")
    return found.select("algorithm_id", "category", "x0", "x1", F.round("area", 9).alias("area"))


@query("w05_first_crossing", with_views("cells") + f""", {POINTS}
SELECT algorithm_id, category, min(strength) FILTER (WHERE tpr <= 0.5) AS strength, round(CASE WHEN min(strength) FILTER (WHERE tpr <= 0.5) IS NULL THEN 'inf'::DOUBLE
  WHEN min(strength) FILTER (WHERE tpr <= 0.5) = min(strength) THEN '-inf'::DOUBLE ELSE arg_min(nqd, strength) FILTER (WHERE tpr <= 0.5) END, 6) AS nqd FROM p GROUP BY 1, 2""")
def first_crossing(s, d):
    """Where detection first falls to a half, and the degradation there: without end if it never does, below all if at once."""
    points = C.curve_points(cells(s, d), "algorithm_id", "category", "strength")
    at = points.groupBy("algorithm_id", "category").agg(F.min(F.when(F.col("tpr") <= 0.5, F.col("strength"))).alias("strength"))
    return at.join(C.quality_at(points, ["algorithm_id", "category"], 0.5, "nqd"), ["algorithm_id", "category"]).withColumn("nqd", F.round("nqd", 6))


#: Searches of a results page: text, status, attack.
SEARCHES = [(" ALG-1", None, None), ("", "failed", "atk-7"), ("12-3", "succeeded", None), ("", None, None)]


def _search_sql(number: int, text: str, status: str | None, attack: str | None) -> str:
    needle = text.strip().lower()
    rules = [f"({' OR '.join(f"contains(lower({c}), '{needle}')" for c in ('cell_key', 'algorithm_id', 'attack_id'))})"]
    rules += [f"status = '{status}'"] if status else []
    rules += [f"attack_id = '{attack}'"] if attack else []
    return f"SELECT {number} AS search, algorithm_id, count(*) AS n, CAST(sum(samples) AS BIGINT) AS samples FROM cells WHERE {' AND '.join(rules)} GROUP BY 2"


@query("p16_search", with_views("cells") + " UNION ALL ".join(_search_sql(i, *x) for i, x in enumerate(SEARCHES)))
def search(s, d):
    own, out = cells(s, d).select("cell_key", "algorithm_id", "attack_id", "status", "samples"), None
    for number, wanted in enumerate(SEARCHES):
        found = P.searched(own, *wanted).groupBy(F.lit(number).alias("search"), "algorithm_id").agg(F.count(F.lit(1)).alias("n"), F.sum("samples").alias("samples"))
        out = found if out is None else out.unionByName(found)
    return out
