"""Registered queries: default sweeps and run plans, resources, exports, and readers on tables in the shape of their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustlake.functions import numeric as N
from robustlake.functions import pixels as X
from robustlake.functions import strings as S
from robustlake.functions.kernels import attempted, canonical
from robustlake.functions.marks import marked, unmarked
from robustlake.operators import records as R
from robustlake.plans.bindings import blocks, cells, table, with_views
from robustlake.plans.registry import query
from robustlake.sources import readers, writers

#: The strengths that each method is run at, and the parameter that takes the strength.
DEFAULT_SWEEPS = {
    "2x_regen": [0.0, 0.5, 1.0], "4x_regen": [0.0, 0.5, 1.0], "brightness": [0.25, 0.5, 0.75], "combined_physical": [0.0, 0.5, 1.0],
    "contrast": [0.25, 0.5, 0.75], "cew_e1": [0.0, 0.5, 1.0], "cew_e2": [0.0, 0.5, 1.0], "cew_e3": [0.0, 0.5, 1.0], "cew_e4": [0.0, 0.5, 1.0],
    "cew_s1": [2.0, 4.0], "cew_s2": [2.0, 4.0], "cew_s3": [2.0, 4.0], "erasing": [0.25, 0.5, 0.75], "gaussian_blur": [0.2, 0.4, 0.6],
    "gaussian_noise": [0.25, 0.5, 0.75], "image_to_vedio": [20.0, 40.0, 60.0], "jpeg": [0.25, 0.5, 0.75], "noise_to_image": [0.0, 0.5, 1.0],
    "print_camera": [0.0, 0.5, 1.0], "regen_diffusion": [0.0, 0.5, 1.0], "resized_crop": [0.1, 0.3, 0.5], "rotation": [0.25, 0.5, 0.75],
    "screen_shoot": [0.0, 0.5, 1.0],
}
STRENGTH_PARAMETER = {
    "2x_regen": "strength", "4x_regen": "strength", "cew_e1": "strength", "cew_e2": "strength", "cew_e3": "strength", "cew_e4": "strength",
    "cew_s1": "scale", "cew_s2": "scale", "cew_s3": "scale", "combined_physical": "strength", "image_to_vedio": "xy", "noise_to_image": "step",
    "print_camera": "strength", "regen_diffusion": "strength", "screen_shoot": "strength",
}
#: Distortions take a relative strength, and so do the viewpoint motions.
RELATIVE = ("brightness", "contrast", "erasing", "gaussian_blur", "gaussian_noise", "jpeg", "resized_crop", "rotation")
MOTION = "3d_viewpoint_rerendering_rotate_point"
METHODS = [*DEFAULT_SWEEPS, MOTION, "cew_c1", "identity", "regen_vae"]


def parameter_of(method: str) -> str | None:
    return STRENGTH_PARAMETER.get(method) or ("strength" if method in RELATIVE or method == MOTION else None)


def catalog(s):
    """method, sweep, parameter: small and fixed."""
    rows = [(m, DEFAULT_SWEEPS.get(m, [0.0, 0.5, 1.0] if m == MOTION else [0.0]), parameter_of(m)) for m in METHODS]
    return s.createDataFrame(rows, "method string, sweep array<double>, parameter string")


def injected(parameter, strength):
    """parameter=value of an attack that takes its strength; scales and offsets are whole numbers; the empty text for others."""
    whole = parameter.isin("scale", "xy")
    return F.when(parameter.isNull(), F.lit("")).otherwise(F.concat_ws("=", parameter, F.when(whole, strength.cast("int").cast("string")).otherwise(strength.cast("string"))))


CATALOG_SQL = "catalog(method, sweep, parameter) AS (VALUES " + ", ".join(
    f"('{m}', {DEFAULT_SWEEPS.get(m, [0.0, 0.5, 1.0] if m == MOTION else [0.0])}::DOUBLE[], {repr(parameter_of(m)) if parameter_of(m) else 'NULL'})" for m in METHODS
) + ")"
METHOD = "(" + repr(METHODS) + f")[1 + p_partkey % {len(METHODS)}]"
VALUE_SQL = "CASE WHEN parameter IS NULL THEN '' WHEN parameter IN ('scale', 'xy') THEN parameter || '=' || CAST(strength AS INTEGER) ELSE parameter || '=' || strength END"


def methods(s, d):
    """Each part asks for one method of the catalog."""
    names = F.array(*[F.lit(m) for m in METHODS])
    return table(s, d, "part").select("p_partkey", "p_size", F.element_at(names, (1 + F.col("p_partkey") % len(METHODS)).cast("int")).alias("method"))


@query("c04_default_sweeps", f"""WITH {CATALOG_SQL}, asked AS (SELECT p_partkey, {METHOD} AS method FROM part)
SELECT p_partkey, method, len(sweep) AS n, sweep[1] AS low, sweep[-1] AS high, parameter, contains(method, 'regen') OR method IN ('noise_to_image', 'image_to_vedio')
  OR regexp_matches(method, '^cew_[dsc]|_deep$|^3d_viewpoint_rerendering_(swipe|shake|rotate|rotate_forward)_(point|ahead)$') AS gpu FROM asked JOIN catalog USING (method)""")
def default_sweeps(s, d):
    own = methods(s, d).join(F.broadcast(catalog(s)), "method")
    return own.select("p_partkey", "method", F.size("sweep").cast("long").alias("n"), F.col("sweep")[0].alias("low"), F.element_at("sweep", -1).alias("high"), "parameter", S.needs_gpu(F.col("method")).alias("gpu"))


@query("c03_run_plan", f"""WITH {CATALOG_SQL}, asked AS (SELECT p_brand AS run, {METHOD} AS method, p_size FROM part), v AS (
  SELECT DISTINCT run, method, unnest(CASE WHEN p_size > 45 THEN [p_size / 100] ELSE sweep END) AS strength, parameter FROM asked JOIN catalog USING (method)),
plan AS (SELECT run, method, string_agg(method || '@' || strength || '[' || ({VALUE_SQL}) || ']', ';' ORDER BY strength) AS variants, count(*) AS n FROM v GROUP BY 1, 2)
SELECT run, CAST(sum(n) AS BIGINT) AS n_cells, string_agg(variants, '|' ORDER BY method) AS attacks FROM plan GROUP BY 1""")
def run_plan(s, d):
    """Every attack of a run with its variants: strength, parameters and key."""
    own = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("run"))
    asked = methods(s, d).join(own, "p_partkey").join(F.broadcast(catalog(s)), "method")
    wanted = F.when(F.col("p_size") > 45, F.array(F.col("p_size") / 100)).otherwise(F.col("sweep"))
    v = asked.select("run", "method", F.explode(wanted).alias("strength"), "parameter").distinct()
    text = F.concat(F.col("method"), F.lit("@"), F.col("strength").cast("string"), F.lit("["), injected(F.col("parameter"), F.col("strength")), F.lit("]"))
    held = F.array_sort(F.collect_list(F.struct("strength", text.alias("text"))))
    plan = v.groupBy("run", "method").agg(F.array_join(F.transform(held, lambda x: x["text"]), ";").alias("variants"), F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("method", "variants")))
    return plan.groupBy("run").agg(F.sum("n").alias("n_cells"), F.array_join(F.transform(lines, lambda x: x["variants"]), "|").alias("attacks"))


@query("c08_enriched_attacks", f"""WITH asked AS (SELECT p_partkey, p_brand AS pack, {METHOD} AS method FROM part), installed AS (SELECT DISTINCT p_brand AS pack FROM part WHERE p_size > 48), remote AS (SELECT DISTINCT p_brand AS pack FROM part WHERE p_size < 3),
state AS (SELECT p_partkey, method, pack, contains(method, 'regen') OR starts_with(method, 'cew_s') AS needed, installed.pack IS NOT NULL AS there, remote.pack IS NOT NULL AS away
  FROM asked LEFT JOIN installed USING (pack) LEFT JOIN remote USING (pack))
SELECT p_partkey, CASE WHEN needed THEN pack END AS weights_pack, needed AS weights_required, NOT needed OR there AS weights_installed, needed AND away AS remote_available, needed AND (there OR away) AS download_ready FROM state""")
def enriched_attacks(s, d):
    """Methods with the state of the weights that they need: those without any count as installed, and are not looked up."""
    part = table(s, d, "part")
    pack = F.col("p_brand").alias("pack")
    there = part.where("p_size > 48").select(pack).distinct().withColumn("there", F.lit(True))
    away = part.where("p_size < 3").select(pack).distinct().withColumn("away", F.lit(True))
    own = methods(s, d).select("p_partkey", "method").join(part.select("p_partkey", pack), "p_partkey")
    needed = F.col("method").contains("regen") | F.col("method").startswith("cew_s")
    own = own.withColumn("needed", needed).join(there, "pack", "left").join(away, "pack", "left").fillna(False, ["there", "away"])
    return own.select(
        "p_partkey",
        F.when(F.col("needed"), F.col("pack")).alias("weights_pack"),
        F.col("needed").alias("weights_required"),
        (~F.col("needed") | F.col("there")).alias("weights_installed"),
        (F.col("needed") & F.col("away")).alias("remote_available"),
        (F.col("needed") & (F.col("there") | F.col("away"))).alias("download_ready"),
    )


@query("c09_dataset_alias", """WITH entries AS (SELECT n_nationkey AS id, n_name AS name, r_name || ' ' || n_name AS other FROM nation JOIN region ON n_regionkey = r_regionkey),
alias AS (SELECT id, lower(regexp_replace(unnest([name, other, replace(name, ' ', '-')]), '[^A-Za-z0-9]', '', 'g')) AS alias FROM entries),
first AS (SELECT alias, min(id) AS id FROM alias GROUP BY 1), asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || lower(name) WHEN 1 THEN other WHEN 2 THEN replace(other, ' ', '__') ELSE 'no ' || name END AS said FROM customer JOIN entries ON c_nationkey = id)
SELECT c_custkey, first.id AS dataset_id, coalesce('datasets/' || first.id, 'datasets/' || trim(said)) AS root FROM asked LEFT JOIN first ON alias = lower(regexp_replace(said, '[^A-Za-z0-9]', '', 'g'))""")
def dataset_alias(s, d):
    """A dataset under any of its names; an unknown one keeps the name that was said."""
    region, nation = F.broadcast(table(s, d, "region")), table(s, d, "nation")
    entries = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat_ws(" ", "r_name", "n_name").alias("other"))
    alias = entries.select("id", F.explode(F.array("name", "other", F.replace("name", F.lit(" "), F.lit("-")))).alias("a")).select("id", S.dataset_key(F.col("a")).alias("alias"))
    first = alias.groupBy("alias").agg(F.min("id").alias("dataset_id"))  # tens of rows
    turn = F.col("c_custkey") % 4
    said = F.when(turn == 0, F.concat(F.lit("  "), F.lower("name"))).when(turn == 1, F.col("other")).when(turn == 2, F.replace("other", F.lit(" "), F.lit("__"))).otherwise(F.concat(F.lit("no "), F.col("name")))
    asked = table(s, d, "customer").join(F.broadcast(entries), F.col("c_nationkey") == F.col("id")).select("c_custkey", said.alias("said"))
    found = asked.select("c_custkey", "said", S.dataset_key(F.col("said")).alias("alias")).join(F.broadcast(first), "alias", "left")
    return found.select("c_custkey", "dataset_id", F.concat(F.lit("datasets/"), F.coalesce(F.col("dataset_id").cast("string"), F.trim("said"))).alias("root"))


@query("j21_reference_fallback", f"""WITH asked AS (SELECT p_partkey, {METHOD} AS method, ['nothing', {METHOD}, 'jpeg', 'rotation'] AS ran FROM part), refs AS (SELECT method, 'doi:' || method AS reference FROM (SELECT DISTINCT {METHOD} AS method FROM part) WHERE length(method) % 2 = 0),
steps AS (SELECT p_partkey, 0 AS pos, method FROM asked UNION ALL SELECT p_partkey, unnest(range(1, 5)), unnest(ran) FROM asked)
SELECT p_partkey, arg_min(reference, pos) AS reference FROM steps LEFT JOIN refs USING (method) GROUP BY 1""")
def reference_fallback(s, d):
    own = methods(s, d)
    refs = own.select("method").distinct().where(F.length("method") % 2 == 0).select("method", F.concat(F.lit("doi:"), "method").alias("reference"))
    asked = own.select("p_partkey", "method", F.array(F.lit("nothing"), F.col("method"), F.lit("jpeg"), F.lit("rotation")).alias("ran"))
    return R.referenced(asked, refs, "p_partkey", "method", "ran")


LABELS = ["distortion-single", "physical-screen", "physical-print", "physical-combined", "consumer-enhancement-workflow", "regeneration_attacks", "3d_viewpoint_rerendering", "distortions", "identity"]


@query("f09_five_class", f"""WITH own AS (SELECT p_partkey, {LABELS!r}[1 + p_partkey % {len(LABELS)}] AS label FROM part)
SELECT p_partkey, label, CASE label WHEN 'distortion-single' THEN 'distortion_attacks' WHEN 'physical-screen' THEN 'physical_channel_attacks' WHEN 'physical-print' THEN 'physical_channel_attacks' WHEN 'physical-combined' THEN 'physical_channel_attacks'
  WHEN 'consumer-enhancement-workflow' THEN 'consumer_enhancement_workflow_attacks' WHEN 'regeneration_attacks' THEN label WHEN '3d_viewpoint_rerendering' THEN label END AS category FROM own""")
def five_class(s, d):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (1 + F.col("p_partkey") % len(LABELS)).cast("int"))
    return table(s, d, "part").select("p_partkey", label.alias("label")).select("*", S.five_class(F.col("label")).alias("category"))


AXES = ["rotate", "rotate_forward", "swipe", "jpeg"]
RAN = ["3d_viewpoint_rerendering_rotate_point", "3d_viewpoint_rerendering_rotate_forward_ahead", "3d_viewpoint_rerendering_swipe_ahead", "jpeg", "rotate"]


@query("f10_on_axis", f"""WITH own AS (SELECT event_id, {RAN!r}[1 + event_id % 5] AS method, {AXES!r}[1 + (event_id // 5) % 4] AS axis FROM events)
SELECT event_id, method, axis, (method, axis) IN (('3d_viewpoint_rerendering_rotate_point', 'rotate'), ('3d_viewpoint_rerendering_rotate_forward_ahead', 'rotate_forward'), ('3d_viewpoint_rerendering_swipe_ahead', 'swipe'), ('jpeg', 'jpeg'), ('rotate', 'rotate')) AS matches FROM own""")
def on_axis(s, d):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k).cast("int"))
    own = table(s, d, "events").select("event_id", pick(RAN, F.col("event_id") % 5).alias("method"), pick(AXES, F.floor(F.col("event_id") / 5) % 4).alias("axis"))
    return own.select("*", S.on_axis(F.col("method"), F.col("axis")).alias("matches"))


@query("f17_run_label", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 AND o_custkey % 5 > 0 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'ImageNet' ELSE 'set-a' END) || ' ' || format('{:,}', CAST(o_custkey % 5 * 1250 AS BIGINT)) || '-image experiment'
  WHEN o_orderkey % 3 = 1 THEN 'Imported run ' || o_custkey ELSE CAST(o_orderkey AS VARCHAR) END AS label FROM orders""")
def run_label(s, d):
    turn, imported = F.col("o_orderkey") % 3, F.concat(F.lit("Imported run "), F.col("o_custkey"))
    sets = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("imagenet"))).otherwise(F.array(F.lit("set-a"), F.lit("imagenet")))
    task, config = F.when(turn == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.lit(" ")), F.when(turn == 1, imported)
    return table(s, d, "orders").select("o_orderkey", S.run_label(task, config, F.col("o_orderkey").cast("string"), sets, F.col("o_custkey") % 5 * 1250).alias("label"))


@query("m08_size_policy", """WITH own AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 <> 0 AS known, l_suppkey % 4 = 0 AS semantic, l_quantity > 25 AS same FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT known AND NOT semantic THEN 'changed_size' WHEN NOT known THEN 'semantic_size_change' WHEN same THEN 'preserve_input_size' WHEN semantic THEN 'semantic_size_change' ELSE 'resized_back_to_input' END AS policy,
  CASE WHEN known THEN same OR NOT semantic END AS preserved, known AND NOT same AND NOT semantic AS resized FROM own""")
def size_policy(s, d):
    size = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    before = F.when(F.col("l_partkey") % 5 != 0, size(300, 200))
    after = F.when(F.col("l_quantity") > 25, size(300, 200)).otherwise(size(200, 300))
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.size_policy(before, after, F.col("l_suppkey") % 4 == 0).alias("p"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "p.policy", "p.preserved", "p.resized")


@query("o07_visible_pages", """WITH own AS (SELECT p_partkey, 1 + p_partkey % p_size AS page, p_size AS pages FROM part)
SELECT p_partkey, array_to_string(CASE WHEN pages <= 9 THEN range(1, pages + 1) ELSE list_sort(list_distinct(list_filter([1, pages, page - 1, page, page + 1], lambda p: p BETWEEN 1 AND pages))) END, ',') AS shown FROM own""")
def visible_pages(s, d):
    page, pages = (1 + F.col("p_partkey") % F.col("p_size")).cast("int"), F.col("p_size").cast("int")
    return table(s, d, "part").select("p_partkey", F.array_join(N.visible_pages(page, pages), ",").alias("shown"))


@query("k03_csv_lines", with_views("cells") + ''', own AS (SELECT algorithm_id, attack_id, avg(strength) AS s, count(*) AS n, max(tpr) AS t FROM cells GROUP BY 1, 2)
SELECT '"run_id","result_unit_key","algorithm_id","attack_preset_id","attack_strength","status","bit_accuracy","ber","tpr_at_fpr","nqd","manifest_path"' AS line
UNION ALL SELECT '"run ""1""","' || algorithm_id || '/' || attack_id || '","' || algorithm_id || '","' || attack_id || '","' || n % 4 || '","succeeded","' || regexp_replace(CAST(t AS VARCHAR), '\\.0$', '') || '","","' || CASE WHEN n % 2 = 0 THEN '0.5' ELSE '1' END || '","","/tmp/a""b.json"' FROM own
UNION ALL SELECT '' UNION ALL SELECT '"protocol_id","protocol","status","final","wrs","80"' AS line''')
def result_lines(s, d):
    own = cells(s, d).groupBy("algorithm_id", "attack_id").agg(F.count(F.lit(1)).alias("n"), F.max("tpr").alias("bit_accuracy"))
    rows = own.select(
        F.lit('run "1"').alias("run_id"), F.concat_ws("/", "algorithm_id", "attack_id").alias("result_unit_key"), "algorithm_id", F.col("attack_id").alias("attack_preset_id"),
        (F.col("n") % 4).cast("double").alias("attack_strength"), F.lit("succeeded").alias("status"), "bit_accuracy", F.lit(None).cast("double").alias("ber"),
        F.when(F.col("n") % 2 == 0, 0.5).otherwise(1.0).alias("tpr_at_fpr"), F.lit(None).cast("double").alias("nqd"), F.lit('/tmp/a"b.json').alias("manifest_path"),
    )
    return writers.results_csv(rows, ["result_unit_key"], "protocol", "final", 80.0).select("line")


@query("k04_leaderboard_csv", """SELECT '"rank","algorithm_id","protocol_status","wrs","clean_fidelity","avg_nqd","coverage","runtime_ms","run_id"' AS line UNION ALL
SELECT '"' || row_number() OVER (ORDER BY c_custkey) || '","' || c_name || '","' || CASE WHEN c_nationkey > 4 THEN 'final' ELSE 'provisional' END || '","' || c_nationkey || '","","0.25","' || least(5, c_nationkey) || '/5","","' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END || '"' FROM customer""")
def leaderboard_lines(s, d):
    own = table(s, d, "customer").select("*", F.lit("all").alias("every"))
    own = R.numbered(own, "every", ["c_custkey"], "rank")
    rows = own.select(
        "rank", F.col("c_name").alias("algorithm_id"), F.when(F.col("c_nationkey") > 4, "final").otherwise("provisional").alias("protocol_status"),
        F.col("c_nationkey").cast("double").alias("wrs"), F.lit(None).cast("double").alias("clean_fidelity"), F.lit(0.25).alias("avg_nqd"),
        F.concat_ws("/", F.least(F.lit(5), F.col("c_nationkey")), F.lit(5)).alias("coverage"), F.lit(None).cast("double").alias("runtime_ms"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("run_id"),
    )
    return writers.leaderboard_csv(rows).select("line")


@query("s02_json_document", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0""")
def json_documents(s, d):
    """Broken documents and lists are left out."""
    turn = F.col("event_id")
    value = F.when(turn % 7 == 0, F.substring("props", 1, 3)).when(turn % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("\n "), "props"))
    return readers.documents(table(s, d, "events").select("event_id", value.alias("value")), "k long").select("event_id", "k")


ENDINGS = [".png", ".JPG", ".txt", "/_intermediates/x.webp", ".jpeg.zip", "_intermediates.bmp"]
LISTING = f"(SELECT page_id, 'en/' || page_id || {ENDINGS!r}[1 + page_id % 6] AS relative FROM pages)"


def _listing(s, d):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (1 + F.col("page_id") % len(ENDINGS)).cast("int"))
    return table(s, d, "pages").select("page_id", F.concat(F.lit("en/"), "page_id", ending).alias("relative"))


@query("s03_image_listing", f"SELECT * FROM {LISTING} WHERE regexp_matches(lower(relative), '\\.(png|jpg|jpeg|bmp|webp)$')")
def image_rows(s, d):
    return readers.images(_listing(s, d))


@query("s04_without_intermediates", f"SELECT * FROM {LISTING} WHERE regexp_matches(lower(relative), '\\.(png|jpg|jpeg|bmp|webp)$') AND NOT contains(relative, '/_intermediates/')")
def plain_image_rows(s, d):
    return readers.images(_listing(s, d), intermediates=False)


@query("s09_key_probe", "SELECT DISTINCT 'k' || l_partkey AS key, p_partkey IS NOT NULL AS found, 1000 + CASE WHEN p_partkey IS NOT NULL THEN 300 ELSE 60 END AS expires_at FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 20) ON p_partkey = l_partkey")
def key_probe(s, d):
    key = lambda c: F.concat(F.lit("k"), c).alias("key")
    return readers.probed(table(s, d, "lineitem").select(key("l_partkey")), table(s, d, "part").where("p_size > 20").select(key("p_partkey")), F.lit(1000))


@query("s11_device_csv", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey AS INTEGER) AS device, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS utilization, l_tax AS power_draw, CASE WHEN l_linenumber % 2 = 0 THEN 300.5::DOUBLE END AS power_limit
FROM lineitem WHERE l_linenumber <> 5""")
def device_rows(s, d):
    """Seven or eight columns; numbers that do not parse are null; other lines are left out."""
    line = table(s, d, "lineitem")
    first = F.concat_ws(", ", "l_suppkey", F.lit("card"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("[N/A]")).otherwise(F.col("l_quantity").cast("string")), F.lit("10"), F.lit("100"), F.lit("40"), "l_tax")
    value = F.when(F.col("l_linenumber") == 5, F.lit("broken, line")).when(F.col("l_linenumber") % 2 == 0, F.concat(first, F.lit(",300.5"))).otherwise(first)
    found = readers.device_csv(line.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value")))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "device", "utilization", "power_draw", "power_limit")


@query("s13_relocated_runs", """SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 = 0 THEN 'old/' || o_orderkey WHEN o_custkey % 3 = 1 THEN 'here/' || o_orderkey END AS root FROM orders""")
def relocated_runs(s, d):
    o, turn = table(s, d, "orders"), F.col("o_custkey") % 3
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("old/"), "o_orderkey").alias("declared"), F.concat(F.lit("here/"), "o_orderkey").alias("local"))
    old, here = o.where(turn == 0).select(F.concat(F.lit("old/"), "o_orderkey").alias("path")), o.where(turn < 2).select(F.concat(F.lit("here/"), "o_orderkey").alias("path"))
    return readers.relocated(runs, old.unionByName(here)).select("run_id", "root")


@query("s14_markdown_rows", "SELECT p_brand AS id, arg_max(p_size, p_partkey) AS size FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1")
def markdown_rows(s, d):
    """The last row of an id wins; text, rules and short rows are left out."""
    row = F.concat(F.lit("| "), "p_partkey", F.lit(" | `"), "p_brand", F.lit("` | "), "p_size", F.lit(" | x | y |"))
    value = F.when(F.col("p_partkey") % 10 == 0, F.lit("|---|---|---|---|---|")).when(F.col("p_partkey") % 5 == 0, F.lit("| 1 | `x` |")).otherwise(row)
    found = readers.markdown_table(table(s, d, "part").select(F.col("p_partkey").alias("line"), value.alias("value")))
    return found.select("id", F.element_at("cells", 3).cast("int").alias("size"))


@query("x25_haar_round_trip", "SELECT vec_id, right('0000000000000000' || bin(vec_id * 7919 % 65536), 16) AS sent, right('0000000000000000' || bin(vec_id * 7919 % 65536), 16) AS received FROM embeddings")
def haar(s, d):
    """Pixels are drawn in from black and white first, where the cut to 0..255 would take the bits."""
    sent = blocks(s, d).select("vec_id", F.transform("px", lambda v: F.least(F.lit(190), F.greatest(F.lit(60), v))).alias("px"), F.lpad(F.bin(F.col("vec_id") * 7919 % 65536), 16, "0").alias("sent"))
    return sent.select("vec_id", "sent", X.haar_extract(X.haar_embed(F.col("px"), F.col("sent"), 18.0), 16, 18.0).alias("received"))


@query("x32_canonical")
def canonical_blocks(s, d):
    """Blocks read as 16 x 4 images, as squares of 8; numpy, so no SQL."""
    done = blocks(s, d).select("vec_id", canonical(F.col("px"), F.lit(16), F.lit(4), 8).alias("c"))
    return done.select("vec_id", F.array_join("c.resized", "x").alias("resized"), F.array_join("c.box", ",").alias("box"), F.size("c.px").alias("n"), X.mean(F.col("c.px")).alias("mean"))


@query("u06_errors_as_data", with_views("blocks") + "SELECT vec_id, vec_id % 5 <> 0 AS ok, CASE WHEN vec_id % 5 = 0 THEN 'ValueError' END AS error, CASE WHEN vec_id % 5 <> 0 THEN 64 END AS n FROM blocks")
def errors_as_data(s, d):
    """Every fifth image has a pixel too few: an error in its row, and none in the others."""
    broken = F.when(F.col("vec_id") % 5 == 0, F.slice("px", 1, 63)).otherwise(F.col("px"))
    done = blocks(s, d).select("vec_id", attempted(broken, "contrast", 0.5, F.col("vec_id")).alias("a"))
    return done.select("vec_id", "a.ok", F.substring_index("a.error", ":", 1).alias("error"), F.when(F.col("a.ok"), F.size("a.px")).alias("n"))


SPREAD_SQL = "0.25::DOUBLE * (cos((2 * (i // 8) + 1) * 3 * pi() / 16) * cos((2 * (i % 8) + 1) * 4 * pi() / 16) - cos((2 * (i // 8) + 1) * 4 * pi() / 16) * cos((2 * (i % 8) + 1) * 3 * pi() / 16))"


@query("x22_spread_round_trip", with_views("blocks") + f""", own AS (SELECT vec_id, CAST(vec_id * 7919 // 64 % 2 AS INTEGER) AS bit, list_transform(px, lambda v: least(190, greatest(60, v))) AS px FROM blocks),
turned AS (SELECT *, (CASE WHEN bit = 1 THEN 18.0::DOUBLE ELSE -18.0::DOUBLE END - list_sum(list_transform(range(0, 64), lambda i: px[i + 1] * {SPREAD_SQL}))) / 2 AS t FROM own),
sent AS (SELECT *, list_transform(range(0, 64), lambda i: least(255, greatest(0, floor(px[i + 1] + t * {SPREAD_SQL})))) AS o FROM turned)
SELECT vec_id, bit AS sent, CAST(list_sum(list_transform(range(0, 64), lambda i: o[i + 1] * {SPREAD_SQL})) > 0 AS INTEGER) AS received,
  CAST(list_sum(list_transform(range(0, 64), lambda i: abs(o[i + 1] - px[i + 1]))) AS BIGINT) AS moved FROM sent""")
def spread(s, d):
    bit = (F.floor(F.col("vec_id") * 7919 / 64) % 2).cast("int")
    own = blocks(s, d).select("vec_id", bit.alias("sent"), F.transform("px", lambda v: F.least(F.lit(190), F.greatest(F.lit(60), v))).alias("px"))
    done = own.select("vec_id", "sent", "px", X.spread_embed(F.col("px"), F.col("sent")).alias("out"))
    gaps = F.zip_with("out", "px", lambda a, b: F.abs(a - b).cast("long"))
    return done.select("vec_id", "sent", X.spread_extract(F.col("out")).alias("received"), F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x).alias("moved"))


@query("x26_dwt_dct_svd_round_trip", "SELECT vec_id, CAST(vec_id % 2 AS VARCHAR) AS sent, CAST(vec_id % 2 AS VARCHAR) AS received FROM embeddings")
def dwt_dct_svd(s, d):
    """A block of 8 x 8 holds one bit. Pixels are drawn in from black and white, as for ``x25_haar_round_trip``."""
    own = blocks(s, d).select("vec_id", (F.col("vec_id") % 2).cast("string").alias("sent"), F.transform("px", lambda v: F.least(F.lit(190), F.greatest(F.lit(60), v))).alias("px"))
    return own.select("vec_id", "sent", unmarked(marked(F.col("px"), F.col("sent"), "dwtDctSvd"), 1, "dwtDctSvd").alias("received"))


@query("x26_dwt_dct")
def dwt_dct(s, d):
    """How far the mark moves a block, and the bit that is read back; numpy, so no SQL."""
    own = blocks(s, d).select("vec_id", "px", (F.col("vec_id") % 2).cast("string").alias("sent"))
    done = own.select("vec_id", "px", "sent", marked(F.col("px"), F.col("sent"), "dwtDct").alias("out"))
    return done.select("vec_id", "sent", unmarked(F.col("out"), 1, "dwtDct").alias("received"), F.round(X.psnr(F.col("px"), F.col("out")), 4).alias("psnr"))


def _cs(a: str, b: str, n: int) -> str:
    cov = f"list_avg(list_transform(range(1, {n + 1}), lambda i: {a}[i] * {b}[i])) - list_avg({a}) * list_avg({b})"
    return f"greatest(0.0::DOUBLE, (2 * ({cov}) + 58.5225::DOUBLE) / (list_var_pop({a}) + list_var_pop({b}) + 58.5225::DOUBLE))"


def _half(a: str, side: int) -> str:
    corner = f"i // {side // 2} * {2 * side} + i % {side // 2} * 2"
    return f"list_transform(range(0, {side * side // 4}), lambda i: ({a}[{corner} + 1] + {a}[{corner} + 2] + {a}[{corner} + {side + 1}] + {a}[{corner} + {side + 2}]) / 4.0::DOUBLE)"


@query("x30_structure", with_views("blocks") + f""", l0 AS (SELECT vec_id, px AS a, list_transform(px, lambda v: CAST(least(255, greatest(0, floor(v * 1.4::DOUBLE + 0.5::DOUBLE))) AS INTEGER)) AS b FROM blocks),
l1 AS (SELECT *, {_half('a', 8)} AS a1, {_half('b', 8)} AS b1 FROM l0), l2 AS (SELECT *, {_half('a1', 4)} AS a2, {_half('b1', 4)} AS b2 FROM l1),
h AS (SELECT vec_id, list_aggregate(a, 'entropy') AS ha, list_aggregate(b, 'entropy') AS hb, list_aggregate(list_transform(range(1, 65), lambda i: a[i] * 256 + b[i]), 'entropy') AS hab FROM l0)
SELECT vec_id, round(CASE WHEN ha + hb > 0 THEN 2 * (ha + hb - hab) / (ha + hb) ELSE 1 END, 6) + 0.0::DOUBLE AS nmi, round(pow({_cs('a', 'b', 64)}, 0.0448::DOUBLE / 0.6305) * pow({_cs('a1', 'b1', 16)}, 0.2856::DOUBLE / 0.6305)
  * pow({_cs('a2', 'b2', 4)} * (2 * list_avg(a2) * list_avg(b2) + 6.5025::DOUBLE) / (list_avg(a2) * list_avg(a2) + list_avg(b2) * list_avg(b2) + 6.5025::DOUBLE), 0.3001::DOUBLE / 0.6305), 6) AS ms_ssim FROM l2 JOIN h USING (vec_id)""")
def structure(s, d):
    own = blocks(s, d).select("vec_id", F.col("px").alias("a"), X.brightness(F.col("px"), 1.4).alias("b"))
    a, b = F.col("a"), F.col("b")
    return own.select("vec_id", (F.round(X.nmi(a, b), 6) + F.lit(0.0)).alias("nmi"), F.round(X.ms_ssim(a, b), 6).alias("ms_ssim"))
