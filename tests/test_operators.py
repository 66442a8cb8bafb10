"""Operators against literal expectations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from robustlake.functions import numeric as N
from robustlake.functions import pixels as X
from robustlake.functions import strings as S
from robustlake.operators import progress as P
from robustlake.operators import records as R
from robustlake.operators import scoring as C
from robustlake.operators import telemetry as T


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_compaction_keeps_the_last_write(spark):
    log = spark.createDataFrame([("a", "failed", 1), ("b", "ok", 2), ("a", "ok", 3), (None, "loose", 4), (None, "loose", 5)], "k string, status string, ord int")
    got = R.compacted(log, "k", "ord").orderBy(F.col("first_seen").asc_nulls_last()).collect()
    assert [(r.k, r.status) for r in got] == [("a", "ok"), ("b", "ok"), (None, "loose"), (None, "loose")]
    assert rows(R.latest(log.where("k is not null"), "k", "ord")) == [("a", "ok", 3), ("b", "ok", 2)]


def test_resume_skips_what_last_succeeded(spark):
    log = spark.createDataFrame([("a", "succeeded", 1), ("a", "failed", 2), ("b", "succeeded", 1)], "k string, status string, ord int")
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(R.pending(plan, log, "k", "ord")) == [("a",), ("c",)]


def test_pool_falls_back_to_all(spark):
    full, some = spark.range(4), spark.range(2)
    assert rows(R.pool_beside(full, some)) == [(2,), (3,)]
    assert rows(R.pool_beside(full, full)) == [(0,), (1,), (2,), (3,)]


def test_round_robin_and_reconcile(spark):
    dealt = R.round_robin(spark.range(10).withColumn("d", F.lit("x")), "d", ["id"], 5)
    assert rows(dealt.where("shard = 0").select("id")) == [(0,), (5,)]
    assert rows(R.reconciled(spark.range(3), spark.range(1, 5), "id")) == [(0, "added"), (3, "removed"), (4, "removed")]


def test_sample_is_the_same_at_any_partitioning(spark):
    assert rows(R.hash_sample(spark.range(100), "id", 7, 9)) == rows(R.hash_sample(spark.range(100).repartition(7), "id", 7, 9))


def test_detection_at_fpr(spark):
    df = spark.createDataFrame([("c", 1, 0.95), ("c", 1, 0.85), ("c", 0, 0.25), ("c", 0, 0.4), ("d", 1, 0.5)], "cell_key string, label int, score double")
    got = {r.cell_key: r for r in C.detection_at_fpr(df).collect()}
    assert (got["c"].tpr, got["c"].empirical_fpr, got["c"].threshold) == (1.0, 0.0, 0.4)
    assert got["d"].tpr is None and got["d"].n_control == 0


def test_bit_accuracy(spark):
    pairs = [("1111", "1110", 0.75), ("1111", "0001", 0.25), ("", "1", 0.0), ("10", "1011", 1.0)]
    for a, b, want in pairs:
        assert one(spark, C.bit_accuracy(F.lit(a), F.lit(b))) == want


def test_curve_points_are_weighted(spark):
    df = spark.createDataFrame([(0.0, 10, 0.5, 0.5), (0.0, 30, 0.5, 1.0), (0.5, 20, 0.4, 0.6)], "strength double, samples int, nqd double, tpr double")
    assert rows(C.curve_points(df, "strength")) == [(0.0, 0.5, 0.875, 40), (0.5, 0.4, 0.6, 20)]


def test_leaderboard_of_one_cell(spark):
    df = spark.createDataFrame([("alg", "c1", 0.5, 3, 0.2, 0.8)], "algorithm_id string, category string, strength double, samples int, nqd double, tpr double")
    r = C.leaderboard(df, ["c1", "c2", "c3", "c4", "c5"]).first()
    assert (r.wrs, r.coverage, r.provisional, r["rank"]) == (80.0, "1/5", True, 1)


def test_quality_at(spark):
    df = spark.createDataFrame([("a", 0.0, 0.99, 0.1), ("a", 1.0, 0.9, 0.3), ("b", 0.0, 0.5, 0.2), ("c", 0.0, 1.0, 0.4)], "k string, strength double, tpr double, nqd double")
    assert rows(C.quality_at(df, ["k"], 0.95, "q")) == [("a", 0.3), ("b", float("-inf")), ("c", float("inf"))]


def test_progress(spark):
    assert one(spark, P.percent(F.lit(12), F.lit(10))) == 100 and one(spark, P.percent(F.lit(1), F.lit(0))) == 0
    docs = [(1, 1, 0, "succeeded", 5, 5, 1), (1, 1, 1, "failed", 1, 5, 2), (1, 1, 1, "succeeded", 5, 5, 3), (1, 2, 0, "running", 1, 4, 4), (1, 2, 1, "pending", 0, 4, 5), (2, 1, 0, "paused", 1, 2, 6)]
    df = spark.createDataFrame(docs, "run_id int, phase int, shard_id int, status string, current int, total int, ord int")
    rolled = P.phase_rollup(df)
    assert rows(rolled.select("run_id", "phase", "percent", "status")) == [(1, 1, 100, "succeeded"), (1, 2, 12, "running"), (2, 1, 50, "paused")]
    assert rows(P.current_phase(rolled)) == [(1, 2), (2, 1)]
    assert rows(P.overall(rolled, 2)) == [(1, 56), (2, 0)]


def test_series(spark):
    df = spark.createDataFrame([("g", 1, 12.0, 1e6), ("g", 2, 20.0, 1.1e7), ("g", 3, None, 2e6), ("g", 4, None, 3e6), ("g", 5, 26.0, 5e6)], "k string, t int, v double, e double")
    assert [r.ema for r in T.smoothed(df, "k", ["t"], "v").orderBy("t").collect()] == [12.0, 15.6, 15.6, 15.6, 20.28]
    watts = [r.watts for r in T.power(df, "k", ["t"], "e", F.col("t").cast("double")).orderBy("t").collect()]
    assert watts == [None, 10.0, None, None, 2.0]
    short = spark.createDataFrame([("g", 1, 30.0), ("g", 2, 40.0), ("g", 3, 26.0)], "k string, t int, v double")
    assert [r.median for r in T.rolling_median(short, "k", ["t"], "v").orderBy("t").collect()] == [30.0, 40.0, 30.0]
    assert [r.rate for r in T.rates(short, "k", ["t"], "v", F.col("t").cast("double")).orderBy("t").collect()] == [None, 10.0, 0.0]
    assert T.ring(short, "k", ["t"], 2).count() == 2


def test_strings(spark):
    assert one(spark, S.safe_segment(F.lit("._a b/é-1.x_"))) == "a_b_é-1.x"
    assert one(spark, S.safe_segment(F.lit("..."))) is None
    assert one(spark, S.slug(F.lit("  Hello, World! "))) == "hello-world" and one(spark, S.slug(F.lit("!!"))) == "resource"
    assert one(spark, S.overrides(F.lit("cew_s2=4, B=1; b=2,x=0,y=q,=3"))) == {"cew_s2": 4, "b": 2}
    assert one(spark, S.byte_size(F.lit(1536))) == "1.5 KB" and one(spark, S.byte_size(F.lit(12))) == "12 B"
    assert one(spark, S.bits_of(F.lit("A"), 12)) == "010000010100" and one(spark, S.bits_of(F.lit("0110"), 4)) == "0110"
    assert [tuple(x) for x in one(spark, S.links(F.lit("see [a](http://x) and [b c](y)")))] == [("a", "http://x"), ("b c", "y")]
    names = {"identity": None, "jpeg": "distortion", "rotation": "distortion", "rotate_forward_ahead": "viewpoint", "4x_regen": "regeneration", "cew_c1": "enhancement", "print_camera": "physical"}
    assert {k: one(spark, S.category_of(F.lit(k))) for k in names} == names
    assert [one(spark, S.shortest(F.lit(x))) for x in (0.5, 2.0, 0.0, 10.0)] == ["0.5", "2", "0", "10"]


def test_numbers(spark):
    crop = one(spark, N.cover_crop(F.lit(300), F.lit(200)))
    assert tuple(crop) == (768, 512, 128, 0, 640, 512)
    assert one(spark, N.thresholds(F.array(F.lit(2.0), F.lit(-1.0)))) == [0.95, 0.7]
    assert one(spark, N.anchors(F.lit(0.75), 1.0, 2.0, 4.0)) == 3.0
    assert tuple(one(spark, N.hops(F.lit(0.75)))) == (0.5, 0.25)
    assert one(spark, N.relative(F.lit(1.5), 0.0, 1.0)) is None


def test_pixels(spark):
    px = F.array(*[F.lit(4 * i % 256) for i in range(64)])
    assert one(spark, X.psnr(px, px)) is None and one(spark, X.ssim(px, px)) == pytest.approx(1)
    assert one(spark, X.lsb_extract(X.lsb_embed(px, F.lit("10110")), 5)) == "10110"
    assert one(spark, X.dct_coefficient(px, 0, 0)) == pytest.approx(sum(4 * i % 256 for i in range(64)) / 8)
    for bit in (0, 1):
        assert one(spark, X.qim_extract(X.qim_embed(F.lit(37.5), F.lit(bit), 18.0), 18.0)) == bit


def test_registered_names():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80 and json.dumps(sorted(queries))


def test_smoothing_carries_one_state_over_batches(spark):
    values = [None if k % 7 == 3 else float(k * 37 % 101) for k in range(25_000)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("b", 1, 5.0), (None, 1, 9.0), (None, 2, 90.0)], "k string, t int, v double")
    for jump in (None, 40.0):
        got = T.smoothed(df.repartition(7), "k", ["t"], "v", jump=jump)
        assert "collect_list" not in got._jdf.queryExecution().toString()  # no key becomes one row
        found, at = {(r.k, r.t): r.ema for r in got.collect()}, None
        assert len(found) == len(values) + 3 and found["b", 1] == 5.0 and found[None, 2] == (45.45 if jump is None else 90.0)
        for k, v in enumerate(values):
            if v is not None:
                at = v if at is None or (jump is not None and abs(v - at) > jump) else round((at * 0.55 + v * (1 - 0.55)) * 100) / 100.0
            assert found["a", k] == at


def test_literals_of_plans_and_selections(spark):
    """Expectations that the blueprint lists word for word."""
    from robustlake.operators import records as R
    from robustlake.operators import scoring as C
    from robustlake.plans import reference_queries as Q

    # strengths: numbers once each and in order, an unknown method dropped
    raw = spark.createDataFrame([("m", x) for x in ("1.0", "0", "1.0", "bad", "NaN")], "method string, raw string")
    assert [tuple(r) for r in S.strengths(raw, "method", "raw").collect()] == [("m", "0.0,1.0")]
    # strengths become parameters only where an attack takes one
    asked = [("cew_s1", 4.0), ("cew_c1", 0.5), ("image_to_vedio", 40.0), ("cew_e1", 0.75), ("noise_to_image", 0.75), ("2x_regen", 1.0), ("jpeg", 0.5)]
    df = spark.createDataFrame(asked, "method string, s double").join(Q.catalog(spark), "method").select("method", Q.injected(F.col("parameter"), F.col("s")).alias("p"))
    assert dict(map(tuple, df.collect())) == {"cew_s1": "scale=4", "cew_c1": "", "image_to_vedio": "xy=40", "cew_e1": "strength=0.75", "noise_to_image": "step=0.75", "2x_regen": "strength=1.0", "jpeg": "strength=0.5"}
    # ten samples on five devices: two each, the first has the samples 0 and 5
    rows = spark.createDataFrame([("d", k) for k in range(10)], "dataset string, k int")
    dealt = {}
    for r in R.round_robin(rows, "dataset", ["k"], 5).collect():
        dealt.setdefault(r.shard, []).append(r.k)
    assert sorted(dealt[0]) == [0, 5] and all(len(v) == 2 for v in dealt.values())
    # one dataset, one algorithm, jpeg with its three strengths and the hidden baseline: four cells
    sweep = dict((r.method, r.sweep) for r in Q.catalog(spark).collect())
    assert len(sweep["jpeg"]) + len(sweep["identity"]) == 4
    # a score is final only with all categories and enough samples
    cell = [("a", c, 0.0, 0.8, 0.1, 40) for c in ("x", "y")]
    cells = spark.createDataFrame(cell, "algorithm_id string, category string, strength double, tpr double, nqd double, samples int")
    assert C.leaderboard(cells, ["x", "y"]).first().provisional is False
    assert C.leaderboard(cells, ["x", "y"], floor=41).first().provisional is True and C.leaderboard(cells, ["x", "y", "z"]).first().provisional is True


def test_places_in_groups_of_many_ranges(spark):
    from robustlake.operators import records as R

    rows = [("a" if k % 3 else None, k * 7 - 50, k) for k in range(100)] + [("a", None, 1000), ("a", 6, 2000)]
    df = spark.createDataFrame(rows, "g string, k int, t int")
    got = {(r.g, r.k, r.t): r.place for r in R.numbered(df, "g", ["k", "t"], width=64).collect()}
    for g in ("a", None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2]), r) for r in rows if r[0] == g)
        assert [got[r] for _, r in own] == list(range(1, len(own) + 1))


def test_order_statistic(spark):
    from robustlake.operators.scoring import order_statistic

    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 400)] + [("b", float(x)) for x in rng.normal(0, 1, 333)] + [("c", 2.5), ("c", 2.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.5, 0.9, 0.999, 1.0):
        got = {r.g: r.value for r in order_statistic(df, "g", "v", share, steps=16).collect()}
        for g in "abc":
            own = sorted(v for k, v in rows if k == g)
            assert got[g] == own[max(1, int(np.ceil(len(own) * share))) - 1], (g, share)


def test_small_functions(spark):
    one = spark.range(1)
    say = lambda c: one.select(c.alias("x")).first().x
    assert say(S.js_number(F.lit(80.0))) == "80" and say(S.js_number(F.lit(0.5))) == "0.5"
    label = lambda *a: say(S.run_label(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for x in a]))
    assert label("Imported run 7", None, "r", ["imagenet"], 1250) == "ImageNet 1,250-image experiment"
    assert label("Imported run 7", None, "r", ["imagenet"], 0) == "Imported run 7" and label(" ", " mine ", "r", ["x"], 5) == "mine"
    assert [say(S.on_axis(F.lit(m), F.lit("rotate"))) for m in ("3d_viewpoint_rerendering_rotate_point", "3d_viewpoint_rerendering_rotate_forward_point", "rotate", "jpeg")] == [True, False, True, False]
    assert say(S.five_class(F.lit("distortion-single"))) == "distortion_attacks" and say(S.five_class(F.lit("physical-screen"))) == "physical_channel_attacks"
    pages = lambda p, n: say(N.visible_pages(F.lit(p), F.lit(n)))
    assert pages(5, 9) == list(range(1, 10)) and pages(1, 20) == [1, 2, 20] and pages(10, 20) == [1, 9, 10, 11, 20] and pages(1, 0) == []
