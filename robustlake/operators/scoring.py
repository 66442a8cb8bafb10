"""Scores of cells: detection at a false-positive target, curves, areas, coverage, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.operators.ranges import attach
from robustlake.storage import settled

#: Engine defaults (configurable), since the blueprint does not show the values: share of controls accepted, and the largest practical degradation.
FPR_TARGET = 0.001
PRACTICAL_NQD = 0.8
#: Samples that each required category must have before a score is final.
SAMPLE_FLOOR = 30


def bit_accuracy(expected: Column, decoded: Column) -> Column:
    """Share of equal bits over the shorter length; 0 if either is empty."""
    n = F.least(F.length(expected), F.length(decoded))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + (F.substr(expected, i, F.lit(1)) == F.substr(decoded, i, F.lit(1))).cast("int"))
    return F.when(n > 0, same / n).otherwise(F.lit(0.0))


#: Steps of the quantile summary (its ranks err by less than one of them), and values of a group that one task ranks.
STEPS, FITS = 1000, 1_000_000


def _bracket(rows: DataFrame, place: Column, steps: int) -> DataFrame:
    """Of each group's values two between which the one at ``place`` (0 to 1, one for each group) lies, from a mergeable summary.

    The summary holds splitters at each of its steps; partial summaries of tasks are merged, no values are kept.
    """
    splitters = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    found = rows.groupBy("g").agg(F.percentile_approx("v", splitters, F.lit(2 * steps)).alias("splits"), F.min("v").alias("least"), F.max("v").alias("most"), F.first(place).alias("place"))
    at = F.floor(F.col("place") * steps).cast("int")
    low = F.when(at >= 2, F.element_at("splits", at - 1)).otherwise(F.col("least"))  # two steps beyond each side
    high = F.when(at + 3 <= steps, F.element_at("splits", F.least(at + 4, F.lit(steps + 1)))).otherwise(F.col("most"))
    return found.select("g", low.alias("low"), high.alias("high"))


def order_statistic(rows: DataFrame, group: str, value: str, share: float, steps: int = STEPS, fits: int = FITS) -> DataFrame:
    """group, value: the smallest value of each group that at least ``share`` of its values do not exceed.

    A mergeable summary of each group gives two splitters around the answer; values below them are counted, and only
    those between them are ranked. While more than ``fits`` different values of a group lie between (ties count
    once, they meet in partial sums), they are summarised again, so no task holds a group, whatever its values are.
    """
    own = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    between = F.col("v").between(F.col("low"), F.col("high"))
    state = settled(own.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("want", F.greatest(F.lit(1), F.ceil(F.col("n") * share)).cast("long")))
    inner, left = own.withColumn("place", F.lit(float(share))), None
    while True:
        bracket = _bracket(inner, F.col("place"), steps)
        kept = [F.coalesce(bracket[c], state[c]).alias(c) if c in state.columns else bracket[c] for c in ("low", "high")]
        state = settled(state.join(bracket, "g", "left").select(state["g"], "n", "want", *kept))
        placed = attach(own, state, "g")
        inside = placed.groupBy("g").agg(F.count_if(F.col("v") < F.col("low")).alias("before"), F.count_if(between).alias("inside"), F.approx_count_distinct(F.when(between, F.col("v"))).alias("values"))
        state = settled(state.select("g", "n", "want", "low", "high").join(inside, "g"))
        crowd = state.where(F.col("values") > fits)
        before, left = left, crowd.agg(F.sum("inside")).first()[0]
        if left is None or before is not None and left > before / 2:  # all fit, or nothing is left to gain
            break
        rest = attach(own, crowd, "g").where(between)
        inner = rest.select("g", "v", ((F.col("want") - F.col("before")) / F.col("inside")).alias("place"))
    counts = attach(own, state, "g").where(between).groupBy("g", "v", "want", "before").agg(F.count(F.lit(1)).alias("many"))
    upto = F.sum("many").over(Window.partitionBy("g").orderBy("v"))
    found = counts.select("g", "v", "want", (F.col("before") + upto).alias("reach")).where("reach >= want")
    return found.groupBy(F.col("g").alias(group)).agg(F.min("v").alias("value"))


def detection_at_fpr(records: DataFrame, cell: str = "cell_key", target: float = FPR_TARGET) -> DataFrame:
    """True positives above the (1 - target) order statistic of the controls, and what the controls do there."""
    controls = order_statistic(records.where("label = 0"), cell, "score", 1 - target).withColumnRenamed("value", "threshold")
    joined = records.join(controls, cell, "left")
    above = (F.col("score") > F.col("threshold")).cast("double")
    positive, control = F.col("label") == 1, F.col("label") == 0
    return joined.groupBy(cell).agg(
        F.round(F.avg(F.when(positive, above)), 6).alias("tpr"),
        F.round(F.avg(F.when(control, above)), 6).alias("empirical_fpr"),
        F.count_if(positive).alias("n_positive"),
        F.count_if(control).alias("n_control"),
        F.round(F.avg(F.when(positive, F.col("score"))), 6).alias("mean_positive"),
        F.round(F.avg(F.when(control, F.col("score"))), 6).alias("mean_control"),
        F.max("threshold").alias("threshold"),
    )


def curve_points(cells: DataFrame, *keys: str) -> DataFrame:
    """Sample-weighted means at each point of a curve; a cell without samples weighs 1."""
    weight = F.when(F.col("samples") > 0, F.col("samples")).otherwise(F.lit(1)).cast("double")
    points = cells.groupBy(*keys).agg(
        F.sum(F.col("nqd") * weight).alias("x"), F.sum(F.col("tpr") * weight).alias("y"), F.sum(weight).alias("w"), F.sum("samples").cast("long").alias("samples")
    )
    return points.select(*keys, (F.col("x") / F.col("w")).alias("nqd"), (F.col("y") / F.col("w")).alias("tpr"), "samples")


def area(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under each curve over its own range, as a mean height; a single point is its height."""
    order = Window.partitionBy(*keys).orderBy(x)
    steps = points.select(*keys, x, y, F.lag(x).over(order).alias("px"), F.lag(y).over(order).alias("py"))
    total, span = F.sum((F.col(x) - F.col("px")) * (F.col(y) + F.col("py")) / 2), F.max(x) - F.min(x)
    return steps.groupBy(*keys).agg(F.when(span > 0, total / span).otherwise(F.avg(y)).alias("auc"), F.count(F.lit(1)).alias("points"))


def segments(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, x0, x1, area: the trapezoids below each curve, between neighbouring points."""
    order = Window.partitionBy(*keys).orderBy(x)
    steps = points.select(*keys, F.lag(x).over(order).alias("x0"), F.col(x).alias("x1"), ((F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2).alias("area"))
    return steps.where("x0 IS NOT NULL")


def category_scores(cells: DataFrame, practical: float = PRACTICAL_NQD) -> DataFrame:
    """Area over strength for each algorithm and category, from practical cells."""
    own = cells.where((F.col("nqd") < practical) & F.col("tpr").isNotNull())
    return area(curve_points(own, "algorithm_id", "category", "strength"), ["algorithm_id", "category"], "strength", "tpr")


def leaderboard(cells: DataFrame, required: list[str], practical: float = PRACTICAL_NQD, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """algorithm_id, wrs (100 x mean of covered categories), coverage and rank.

    Provisional until every required category is covered and no category has fewer samples than the floor.
    """
    scores = category_scores(cells, practical).where(F.col("category").isin(required))
    total = scores.groupBy("algorithm_id").agg(F.round(F.avg("auc") * 100, 6).alias("wrs"), F.count(F.lit(1)).alias("covered"))
    own = cells.where((F.col("nqd") < practical) & F.col("tpr").isNotNull() & F.col("category").isin(required))
    samples = own.groupBy("algorithm_id", "category").agg(F.sum("samples").alias("n")).groupBy("algorithm_id").agg(F.min("n").alias("least"))
    total = total.join(samples, "algorithm_id")
    return total.select(
        "algorithm_id",
        "wrs",
        F.concat_ws("/", "covered", F.lit(len(required))).alias("coverage"),
        ((F.col("covered") < len(required)) | (F.coalesce("least", F.lit(0)) < floor)).alias("provisional"),
        # one row for each algorithm: a table of tens of rows
        F.row_number().over(Window.orderBy(F.col("wrs").desc(), "algorithm_id")).alias("rank"),
    )


def quality_at(points: DataFrame, keys: list[str], level: float, name: str) -> DataFrame:
    """Degradation where performance first falls to ``level`` by strength: inf if never, -inf if at the first point."""
    low = F.col("tpr") <= level
    first = F.min("strength")
    hit = F.min(F.when(low, F.col("strength")))
    at = F.min_by("nqd", F.when(low, F.col("strength")))
    value = F.when(hit.isNull(), F.lit(float("inf"))).when(hit == first, F.lit(float("-inf"))).otherwise(at)
    return points.groupBy(*keys).agg(value.alias(name))


def min_max(value: Column, over: Window | None = None) -> Column:
    """(x - min) / (max - min) over a window of peers; 1 where all are equal."""
    w = over if over is not None else Window.partitionBy(F.lit(1))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high <= low, F.when(value.isNotNull(), F.lit(1.0))).otherwise((value - low) / (high - low))


def weighted(parts: dict[str, float]) -> Column:
    """Mean of the components that are there, by weight; null without any."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)
