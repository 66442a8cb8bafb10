"""Registered queries: samples, searches for the best setting, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustlake.operators import records as R
from robustlake.operators import sampling as S
from robustlake.operators import tuning as T
from robustlake.plans.bindings import cells, profile, table, with_views
from robustlake.plans.registry import query
from robustlake.sources import export, writers
from robustlake.storage import scratch, settled

HASH = "CAST('0x' || substr(sha256('{seed}:' || {key}), 1, 15) AS BIGINT)"


@query("o04_samples", f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY {HASH.format(seed=7, key='p_partkey')}, p_partkey) AS place FROM part),
n AS (SELECT n_nationkey, row_number() OVER (ORDER BY {HASH.format(seed=7, key='n_nationkey')}, n_nationkey) AS place, count(*) OVER () AS total FROM nation),
d AS (SELECT i AS draw, {HASH.format(seed=8, key='i')} AS h FROM range(60) r(i))
SELECT 'part' AS pool, place - 1 AS draw, p_partkey AS sample FROM p WHERE place <= 50
UNION ALL SELECT 'nation', draw, n_nationkey FROM d JOIN n ON place = h % total + 1""")
def samples(s, d):
    """Fifty of many parts without replacement, sixty of 25 nations with it."""
    large = S.sampled(table(s, d, "part").select(F.col("p_partkey").alias("sample")), "sample", 50, 7)
    small = S.sampled(table(s, d, "nation").select(F.col("n_nationkey").alias("sample")), "sample", 60, 7)
    return large.select(F.lit("part").alias("pool"), "draw", "sample").unionByName(small.select(F.lit("nation").alias("pool"), "draw", "sample"))


#: Samples of a full measurement, and samples of a first probe for each unit of a candidate.
TOTAL, FACTOR = 40, 3


def _rounds() -> str:
    """Four rounds of sixteen candidates: all, eight, four, two with all samples."""
    rate = "(SELECT round(avg(k), 6) FROM ranked r WHERE r.item = f.item AND r.candidate = f.candidate AND r.place <= f.samples)"
    sql = with_views("profile") + f""", ranked AS (SELECT stage AS item, batch + 1 AS candidate, k, row_number() OVER (PARTITION BY stage, batch ORDER BY event_id) AS place FROM profile),
f0 AS (SELECT DISTINCT item, candidate, least({TOTAL}, candidate * {FACTOR}) AS samples FROM ranked), m0 AS (SELECT f.*, {rate} AS rate FROM f0 f)"""
    for i, left in enumerate((8, 4, 2), 1):
        more = str(TOTAL) if left == 2 else f"least({TOTAL}, samples * 2)"
        sql += f""", f{i} AS (SELECT item, candidate, {more} AS samples FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY rate DESC, candidate) AS place FROM m{i - 1}) WHERE place <= {left}),
m{i} AS (SELECT f.*, {rate} AS rate FROM f{i} f)"""
    return sql + ", taken AS (" + " UNION ".join(f"SELECT * FROM m{i}" for i in range(4)) + ")"


def search(s, d):
    """Rates of settings by the first samples of their records; the setting of a stage is its batch size."""
    own = profile(s, d).select(F.col("stage").alias("item"), (F.col("batch") + 1).cast("long").alias("candidate"), "k", "event_id")

    def measure(asked):
        # the most that any probe asks for: a group is cut to them before it is ranked
        ranked = R.first_of_each(own.withColumn("cell", F.concat_ws("/", "item", "candidate")), "cell", ["event_id"], TOTAL)
        met = ranked.join(asked, ["item", "candidate"]).where(F.col("place") <= F.col("samples"))
        rates = met.groupBy("item", "candidate", "samples").agg(F.round(F.avg("k"), 6).alias("rate"))
        return asked.join(rates, ["item", "candidate", "samples"], "left").withColumn("ok", F.col("rate").isNotNull())

    found = T.Search(s, scratch(s, "search").path, measure)
    found.run(own.select("item", "candidate").distinct(), TOTAL, FACTOR)
    return found


@query("c13_finalists", _rounds() + "SELECT item, arg_max(candidate, (samples, rate, -candidate)) AS candidate, arg_max(samples, (samples, rate, -candidate)) AS samples, arg_max(rate, (samples, rate, -candidate)) AS rate FROM taken GROUP BY 1")
def finalists(s, d):
    return search(s, d).best()


@query("c13_measured", _rounds() + "SELECT item, candidate, samples, rate FROM taken")
def measured(s, d):
    """Everything that a search has measured: all settings briefly, then the better half with twice the samples."""
    return search(s, d).measured().select("item", "candidate", "samples", "rate")


@query("c12_tuning_samples", with_views("profile") + f"SELECT stage, greatest({TOTAL}, {FACTOR} * max(batch + 1)) AS n_samples FROM profile GROUP BY 1")
def tuning_samples(s, d):
    """As many samples as are asked for, or as some batches of the largest size need."""
    return profile(s, d).groupBy("stage").agg(F.greatest(F.lit(TOTAL), FACTOR * F.max(F.col("batch") + 1)).cast("long").alias("n_samples"))


@query("a41_tuning_summary", _rounds() + """, best AS (SELECT item, arg_max(candidate, (samples, rate, -candidate)) AS value FROM taken GROUP BY 1),
variants AS (SELECT DISTINCT event_type AS item, event_type || '_' || CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'ahead' END AS variant FROM events)
SELECT item, string_agg(variant || '=' || value, ',' ORDER BY variant) AS overrides FROM best JOIN variants USING (item) GROUP BY 1""")
def tuning_summary(s, d):
    """The best setting of each method, handed to all variants of it, as override texts."""
    side = F.element_at(F.array(*[F.lit(x) for x in ("left", "right", "ahead")]), (F.col("user_id") % 3 + 1).cast("int"))
    variants = table(s, d, "events").select(F.col("event_type").alias("item"), F.concat_ws("_", "event_type", side).alias("variant")).distinct()
    pairs = search(s, d).best().join(variants, "item").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("variant", "candidate"))).alias("v"))
    return pairs.select("item", F.array_join(F.transform("v", lambda x: F.concat_ws("=", x["variant"], x["candidate"])), ",").alias("overrides"))


def _lines(columns, rows):
    """SQL of an export's lines: a header and the rows in order."""
    quoted = lambda c: f"""'"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '"', '""') || '"'"""
    head = ",".join(f'"{c}"' for c in columns)
    return f"""SELECT 0 AS line_no, '{head}' AS line UNION ALL SELECT row_number() OVER (ORDER BY {columns[0]}), {" || ',' || ".join(quoted(c) for c in columns)} FROM ({rows})"""


@query("k05_exports", with_views("cells") + f"""SELECT 'attack_leaderboard.csv' AS file, line_no, line FROM ({_lines(["attack_id", "n_cells", "most"], "SELECT attack_id, count(*) AS n_cells, max(samples) AS most FROM cells GROUP BY 1")})
UNION ALL SELECT 'method_profiles.csv', line_no, line FROM ({_lines(["algorithm_id", "failed", "worst"], "SELECT algorithm_id, count(*) FILTER (WHERE status = 'failed') AS failed, 'cat ' || chr(34) || min(category) || chr(34) AS worst FROM cells GROUP BY 1")})""")
def exports(s, d):
    """Two tables of one export, read back after an export that was aborted half way and one that was replaced."""
    own = cells(s, d)
    # the exports read their tables again and again, so the cells are met once: sums for each attack and method
    sums = [F.count(F.lit(1)).alias("n"), F.max("samples").alias("most"), F.count_if(F.col("status") == "failed").alias("failed"), F.min("category").alias("category")]
    both = settled(own.groupBy("attack_id", "algorithm_id").agg(*sums))
    attacks = both.groupBy("attack_id").agg(F.sum("n").alias("n_cells"), F.max("most").alias("most"))
    quoted = F.concat(F.lit('cat "'), F.min("category"), F.lit('"')).alias("worst")
    methods = both.groupBy("algorithm_id").agg(F.sum("failed").alias("failed"), quoted)
    tables = {"attack_leaderboard.csv": writers.csv_lines(attacks, attacks.columns, ["attack_id"]), "method_profiles.csv": writers.csv_lines(methods, methods.columns, ["algorithm_id"])}
    path = scratch(s, "exports").path
    export.write_export({"method_profiles.csv": tables["method_profiles.csv"]}, path)
    broken = tables["attack_leaderboard.csv"].withColumn("line", F.when(F.col("section") == 1, F.raise_error(F.lit("export aborted"))).otherwise(F.col("line")))
    try:
        export.write_export(tables | {"attack_leaderboard.csv": broken}, path)
    except Exception as error:  # of whatever kind Spark reports a task's failure
        if "export aborted" not in str(error):
            raise
    if [r.file for r in export.read_export(s, path).select("file").distinct().collect()] != ["method_profiles.csv"]:
        raise RuntimeError("an aborted export shows")
    export.write_export(tables, path)
    return export.read_export(s, path).withColumnRenamed("at", "line_no")


@query("k01_record_log", """SELECT o_orderkey AS id, o_orderstatus AS status, 'run_event' AS schema, 1 AS version FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def record_log(s, d):
    """A log that was written anew and then appended to, as it reads."""
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    path = f"{scratch(s, 'log').path}/events"
    writers.append_log(own.where("status = 'O'"), path, "run_event")
    writers.write_log(own.where("status = 'F'"), path, "run_event")
    writers.append_log(own.where("status = 'P'"), path, "run_event")
    log = s.read.schema("id long, status string, recordSchema string, schemaVersion int").json(path)
    return log.select("id", "status", F.col("recordSchema").alias("schema"), F.col("schemaVersion").alias("version"))


@query("k07_manifests", with_views("cells") + "SELECT algorithm_id, attack_id, count(*) AS n, CAST(sum(samples) AS BIGINT) AS samples FROM cells WHERE algorithm_id <> 'alg-2' OR status = 'failed' GROUP BY 1, 2")
def manifests(s, d):
    """Manifests by algorithm, those of one written again: its folder alone is replaced."""
    own = cells(s, d).select("algorithm_id", "attack_id", "samples", "status")
    path = f"{scratch(s, 'manifests').path}/attack"
    writers.manifest_rows(own, ["algorithm_id"], path)
    writers.manifest_rows(own.where("algorithm_id = 'alg-2' AND status = 'failed'"), ["algorithm_id"], path)
    back = s.read.schema("attack_id string, samples int, status string, algorithm_id string").parquet(path)
    return back.groupBy("algorithm_id", "attack_id").agg(F.count(F.lit(1)).alias("n"), F.sum("samples").alias("samples"))
