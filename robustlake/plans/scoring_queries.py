"""Registered queries: scoring, curves, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.operators import scoring as S
from robustlake.plans.bindings import cells, detections, with_views
from robustlake.plans.registry import query

CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

POINTS = """points AS (
  SELECT algorithm_id, category, strength, sum(tpr * w) / sum(w) AS tpr
  FROM (SELECT *, CASE WHEN samples > 0 THEN samples ELSE 1 END::DOUBLE AS w FROM cells) WHERE nqd < 0.8 AND tpr IS NOT NULL GROUP BY 1, 2, 3)"""
SCORES = f"""{POINTS}, steps AS (
  SELECT *, lag(strength) OVER w AS px, lag(tpr) OVER w AS py FROM points WINDOW w AS (PARTITION BY algorithm_id, category ORDER BY strength)
), scores AS (
  SELECT algorithm_id, category, CASE WHEN max(strength) > min(strength)
    THEN sum((strength - px) * (tpr + py) / 2) / (max(strength) - min(strength)) ELSE avg(tpr) END AS auc, count(*) AS points
  FROM steps GROUP BY 1, 2)"""


@query("a15_wrs_leaderboard", with_views("cells") + ", " + SCORES + """
, floors AS (SELECT algorithm_id, min(n) AS least FROM (SELECT algorithm_id, category, sum(samples) AS n FROM cells WHERE nqd < 0.8 AND tpr IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT algorithm_id, wrs, covered || '/5' AS coverage, covered < 5 OR least < 30 AS provisional, CAST(row_number() OVER (ORDER BY wrs DESC, algorithm_id) AS INTEGER) AS rank
FROM (SELECT algorithm_id, round(avg(auc) * 100, 6) AS wrs, count(*) AS covered FROM scores GROUP BY 1) JOIN floors USING (algorithm_id)""")
def wrs(s, d):
    return S.leaderboard(cells(s, d), CATEGORIES)


@query("a14_category_auc", with_views("cells") + ", " + SCORES + "SELECT algorithm_id, category, round(auc, 6) AS auc, points FROM scores")
def category_auc(s, d):
    return S.category_scores(cells(s, d)).withColumn("auc", F.round("auc", 6))


@query("a10_tpr_at_fpr", with_views("detections") + """, limits AS (
  SELECT cell_key, quantile_disc(score, 0.999) AS threshold FROM detections WHERE label = 0 GROUP BY 1)
SELECT cell_key, round(avg(CASE WHEN label = 1 THEN CAST(score > threshold AS DOUBLE) END), 6) AS tpr,
  round(avg(CASE WHEN label = 0 THEN CAST(score > threshold AS DOUBLE) END), 6) AS empirical_fpr,
  count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_control,
  round(avg(score) FILTER (WHERE label = 1), 6) AS mean_positive, round(avg(score) FILTER (WHERE label = 0), 6) AS mean_control,
  max(threshold) AS threshold
FROM detections LEFT JOIN limits USING (cell_key) GROUP BY 1""")
def tpr_at_fpr(s, d):
    return S.detection_at_fpr(detections(s, d))


@query("a13_curve_points", with_views("cells") + """
SELECT algorithm_id, attack_id, strength, round(sum(nqd * w) / sum(w), 6) AS nqd, round(sum(tpr * w) / sum(w), 6) AS tpr, CAST(sum(samples) AS BIGINT) AS samples
FROM (SELECT *, CASE WHEN samples > 0 THEN samples ELSE 1 END::DOUBLE AS w FROM cells) GROUP BY 1, 2, 3""")
def curve(s, d):
    points = S.curve_points(cells(s, d), "algorithm_id", "attack_id", "strength")
    return points.withColumns({"nqd": F.round("nqd", 6), "tpr": F.round("tpr", 6)})


ATTACK_POINTS = """pts AS (SELECT algorithm_id, attack_id, strength, sum(nqd * w) / sum(w) AS nqd, sum(tpr * w) / sum(w) AS tpr
  FROM (SELECT *, CASE WHEN samples > 0 THEN samples ELSE 1 END::DOUBLE AS w FROM cells) GROUP BY 1, 2, 3)"""


@query("a19_attack_leaderboard", with_views("cells") + ", " + ATTACK_POINTS + """
SELECT algorithm_id, attack_id, round(avg(tpr), 6) AS avg_p, round(avg(nqd), 6) AS avg_q,
  CASE WHEN min(strength) FILTER (WHERE tpr <= 0.95) IS NULL THEN 'inf'::DOUBLE WHEN min(strength) FILTER (WHERE tpr <= 0.95) = min(strength) THEN '-inf'::DOUBLE
    ELSE round(arg_min(nqd, strength) FILTER (WHERE tpr <= 0.95), 6) END AS q95,
  CASE WHEN min(strength) FILTER (WHERE tpr <= 0.7) IS NULL THEN 'inf'::DOUBLE WHEN min(strength) FILTER (WHERE tpr <= 0.7) = min(strength) THEN '-inf'::DOUBLE
    ELSE round(arg_min(nqd, strength) FILTER (WHERE tpr <= 0.7), 6) END AS q70
FROM pts GROUP BY 1, 2""")
def attacks(s, d):
    keys = ["algorithm_id", "attack_id"]
    points = S.curve_points(cells(s, d), *keys, "strength")
    mean = points.groupBy(*keys).agg(F.round(F.avg("tpr"), 6).alias("avg_p"), F.round(F.avg("nqd"), 6).alias("avg_q"))
    out = mean
    for level, name in ((0.95, "q95"), (0.7, "q70")):
        out = out.join(S.quality_at(points, keys, level, name).withColumn(name, F.round(name, 6)), keys)
    return out


@query("a16_coverage", with_views("cells") + """
SELECT algorithm_id, count(DISTINCT category) FILTER (WHERE nqd < 0.3) AS covered, count(*) FILTER (WHERE nqd < 0.3) AS n_cells,
  coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (WHERE nqd < 0.3))), ','), '') AS covered_list,
  coalesce(min(samples) FILTER (WHERE nqd < 0.3), 0) >= 5 AS meets_floor
FROM cells GROUP BY 1""")
def coverage(s, d):
    own = F.col("nqd") < 0.3
    return cells(s, d).groupBy("algorithm_id").agg(
        F.countDistinct(F.when(own, F.col("category"))).alias("covered"),
        F.count_if(own).alias("n_cells"),
        F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("category")))), ",").alias("covered_list"),
        (F.coalesce(F.min(F.when(own, F.col("samples"))), F.lit(0)) >= 5).alias("meets_floor"),
    )


@query("a17_category_rows", with_views("cells") + """
SELECT algorithm_id, category, round(avg(tpr), 6) AS mean_tpr, round(avg(nqd), 6) AS mean_nqd, count(*) AS n_cells, count(DISTINCT attack_id) AS n_attacks
FROM cells WHERE nqd < 0.8 GROUP BY 1, 2""")
def category_rows(s, d):
    return cells(s, d).where("nqd < 0.8").groupBy("algorithm_id", "category").agg(
        F.round(F.avg("tpr"), 6).alias("mean_tpr"), F.round(F.avg("nqd"), 6).alias("mean_nqd"), F.count(F.lit(1)).alias("n_cells"), F.countDistinct("attack_id").alias("n_attacks")
    )


@query("a18_profile", with_views("cells") + ", " + SCORES + """
SELECT algorithm_id, round(max(auc) FILTER (WHERE category = '2-HIGH'), 6) AS physical_score, arg_min(category, (round(auc, 9), category)) AS worst_category FROM scores GROUP BY 1""")
def profile(s, d):
    return S.category_scores(cells(s, d)).groupBy("algorithm_id").agg(
        F.round(F.max(F.when(F.col("category") == "2-HIGH", F.col("auc"))), 6).alias("physical_score"),
        F.min_by("category", F.struct(F.round("auc", 9), "category")).alias("worst_category"),
    )


PARTS = """base AS (
  SELECT algorithm_id, avg(tpr) FILTER (WHERE nqd < 0.8) AS robustness, 1 - avg(nqd) AS clean, avg(seed * 10.0::DOUBLE + samples) AS runtime
  FROM cells GROUP BY 1), parts AS (
  SELECT algorithm_id, robustness,
    CASE WHEN max(clean) OVER () <= min(clean) OVER () THEN 1 ELSE (clean - min(clean) OVER ()) / (max(clean) OVER () - min(clean) OVER ()) END AS fidelity,
    CASE WHEN max(ln(1 + runtime)) OVER () <= min(ln(1 + runtime)) OVER () THEN 1 ELSE
      greatest(0, least(1, 1 - (ln(1 + runtime) - min(ln(1 + runtime)) OVER ()) / greatest(0.0001, max(ln(1 + runtime)) OVER () - min(ln(1 + runtime)) OVER ()))) END AS simplicity
  FROM base)"""


def parts(s, d):
    base = cells(s, d).groupBy("algorithm_id").agg(
        F.avg(F.when(F.col("nqd") < 0.8, F.col("tpr"))).alias("robustness"),
        (1 - F.avg("nqd")).alias("clean"),
        F.avg(F.col("seed") * 10.0 + F.col("samples")).alias("runtime"),
    )
    # a row for each algorithm: windows over all of them are over tens of rows
    return base.select(
        "algorithm_id",
        "robustness",
        S.min_max(F.col("clean")).alias("fidelity"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - S.min_max(F.log1p("runtime")))).alias("simplicity"),
    )


@query("a20_components", with_views("cells") + ", " + PARTS + "SELECT algorithm_id, round(robustness, 6) AS robustness, round(fidelity, 6) AS fidelity, round(simplicity, 6) AS simplicity FROM parts")
def components(s, d):
    return parts(s, d).select("algorithm_id", *[F.round(c, 6).alias(c) for c in ("robustness", "fidelity", "simplicity")])


@query("a23_composite_rank", with_views("cells") + ", " + PARTS + """
SELECT algorithm_id, composite, CAST(row_number() OVER (ORDER BY composite DESC, algorithm_id) AS INTEGER) AS rank,
  round(greatest(3, composite / greatest(1, max(composite) OVER ()) * 100), 4) AS bar
FROM (SELECT algorithm_id, round((robustness * 50 + fidelity * 30 + simplicity * 20) / 100 * 100, 6) AS composite FROM parts)""")
def composite(s, d):
    score = parts(s, d).select("algorithm_id", F.round(S.weighted({"robustness": 50.0, "fidelity": 30.0, "simplicity": 20.0}) * 100, 6).alias("composite"))
    everyone = Window.partitionBy(F.lit(1))
    return score.select(
        "algorithm_id",
        "composite",
        F.row_number().over(everyone.orderBy(F.col("composite").desc(), "algorithm_id")).alias("rank"),
        F.round(F.greatest(F.lit(3.0), F.col("composite") / F.greatest(F.lit(1.0), F.max("composite").over(everyone)) * 100), 4).alias("bar"),
    )


@query("p10_practical_cells", with_views("cells") + "SELECT category, count(*) FILTER (WHERE tpr IS NOT NULL AND nqd IS NOT NULL AND nqd < 0.8) AS practical, count(*) AS n FROM cells GROUP BY 1")
def practical(s, d):
    own = F.col("tpr").isNotNull() & F.col("nqd").isNotNull() & (F.col("nqd") < 0.8)
    return cells(s, d).groupBy("category").agg(F.count_if(own).alias("practical"), F.count(F.lit(1)).alias("n"))


@query("a06_run_leaderboard", with_views("cells") + """
SELECT algorithm_id, mean_tpr, n_cells, CAST(row_number() OVER (ORDER BY coalesce(mean_tpr, -1) DESC, algorithm_id) AS INTEGER) AS rank
FROM (SELECT algorithm_id, round(avg(tpr) FILTER (WHERE status = 'succeeded'), 6) AS mean_tpr, count(*) AS n_cells FROM cells GROUP BY 1)""")
def run_board(s, d):
    own = cells(s, d).groupBy("algorithm_id").agg(F.round(F.avg(F.when(F.col("status") == "succeeded", F.col("tpr"))), 6).alias("mean_tpr"), F.count(F.lit(1)).alias("n_cells"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.coalesce("mean_tpr", F.lit(-1.0)).desc(), "algorithm_id")
    return own.select("*", F.row_number().over(order).alias("rank"))


@query("a05_run_aggregate", with_views("cells") + """
SELECT algorithm_id, attack_id, strength, count(*) AS n, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
  round(avg(tpr), 6) AS mean_accuracy, round(avg(1 - tpr), 6) AS mean_error FROM cells GROUP BY 1, 2, 3""")
def run_aggregate(s, d):
    return cells(s, d).groupBy("algorithm_id", "attack_id", "strength").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.avg("tpr"), 6).alias("mean_accuracy"), F.round(F.avg(1 - F.col("tpr")), 6).alias("mean_error"),
    )


@query("a43_axis_stats", with_views("cells") + "SELECT algorithm_id, min(samples) AS min_samples, max(samples) AS max_samples, min(strength) AS min_strength, max(strength) AS max_strength FROM cells GROUP BY 1")
def axis_stats(s, d):
    return cells(s, d).groupBy("algorithm_id").agg(
        F.min("samples").alias("min_samples"), F.max("samples").alias("max_samples"), F.min("strength").alias("min_strength"), F.max("strength").alias("max_strength")
    )


@query("j05_control_pairs", with_views("detections") + """
SELECT cell_key, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_control,
  round(max(score) FILTER (WHERE label = 1) - max(score) FILTER (WHERE label = 0), 6) AS margin FROM detections GROUP BY 1""")
def control_pairs(s, d):
    one, none = F.col("label") == 1, F.col("label") == 0
    return detections(s, d).groupBy("cell_key").agg(
        F.count_if(one).alias("n_positive"), F.count_if(none).alias("n_control"), F.round(F.max(F.when(one, F.col("score"))) - F.max(F.when(none, F.col("score"))), 6).alias("margin")
    )


@query("w16_curve_series", with_views("cells") + ", " + ATTACK_POINTS + """
SELECT algorithm_id, attack_id, count(*) AS n_points, string_agg(printf('%.1f:%.8f', strength, round(tpr, 8)), ' ' ORDER BY strength) AS series FROM pts GROUP BY 1, 2 HAVING count(*) >= 2""")
def curve_series(s, d):
    points = S.curve_points(cells(s, d), "algorithm_id", "attack_id", "strength")
    held = F.array_sort(F.collect_list(F.struct("strength", F.round("tpr", 8).alias("tpr"))))
    rows = points.groupBy("algorithm_id", "attack_id").agg(held.alias("h")).where(F.size("h") >= 2)
    return rows.select("algorithm_id", "attack_id", F.size("h").cast("long").alias("n_points"), F.array_join(F.transform("h", lambda p: F.format_string("%.1f:%.8f", p["strength"], p["tpr"])), " ").alias("series"))
