"""Replayed logs, series and order statistics, with keys that hold most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from robustlake.operators import ranges, runstate
from robustlake.operators import scoring as C
from robustlake.operators import telemetry as T
from robustlake.operators.runstate import RUN_STATES, RUN_STEPS, RUNS, composed, run_log, run_states


def state(spark, *actions, workers=None):
    rows = [("r", i, a, (workers or {}).get(i)) for i, a in enumerate(actions)]
    log = spark.createDataFrame(rows, "run_id string, ord int, action string, worker_id string")
    return run_states(run_log(log)).first()


def test_requests_to_a_queued_run(spark):
    claimed = state(spark, "create", "claim", "claim", workers={1: "worker-a", 2: "worker-b"})
    assert (claimed.status, claimed.worker_id, claimed.refused) == ("running", "worker-a", 1)
    paused = state(spark, "create", "pause")
    assert (paused.status, paused.cancel_requested, paused.resumable) == ("paused", True, True)
    resumed = state(spark, "create", "pause", "resume")
    assert (resumed.status, resumed.cancel_requested) == ("queued", False)
    cancelled = state(spark, "create", "cancel", "resume")
    assert (cancelled.status, cancelled.cancel_requested, cancelled.resumable, cancelled.refused) == ("cancelled", True, False, 1)


def test_requests_to_a_running_run_take_effect_when_it_stops(spark):
    asked = state(spark, "create", "claim", "pause")
    assert (asked.status, asked.cancel_requested) == ("running", True)
    assert state(spark, "create", "claim", "pause", "stop").status == "paused"
    assert state(spark, "create", "claim", "cancel", "stop", "resume").status == "cancelled"
    assert state(spark, "create", "claim", "pause", "cancel", "stop").status == "cancelled"
    stale = state(spark, "create", "claim", "stale", "resume", "claim", workers={1: "a", 4: "b"})
    assert (stale.status, stale.worker_id) == ("running", "b")


def folded(rows):
    at, out = {}, []
    for run, order, action, worker in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        before = at.get(run, "absent")
        after = RUN_STEPS.get((before, action))
        at[run] = after or before
        out.append((run, order, action, worker, before, at[run], after is not None))
    return out


def test_a_log_of_most_rows_is_shared_by_ranges(spark):
    rng = random.Random(4)
    actions = ["create", "claim", "pause", "resume", "stop", "stale", "fail", "partial", "cancel", "archive"]
    weights = [5, 5, 5, 5, 5, 5, 5, 2, 0.02, 1]
    rows = [(rng.choice([7, 7, 7, None, None, rng.randrange(100, 130)]), i, rng.choices(actions, weights)[0], f"w{i % 3}") for i in range(6000)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "run_id long, ord long, action string, worker_id string").repartition(5)
    assert sorted(r["_crowded"] or 0 for r in ranges.crowded(log, "run_id").collect()) == [0, 7]
    got = run_log(log)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(folded(rows), key=str)


def test_no_range_holds_a_crowded_key(spark):
    rows = spark.range(8000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    dealt = ranges.in_ranges(ranges.split(rows, "k")[1], "k", ["id"])
    sizes = [r["count"] for r in dealt.groupBy(ranges.PART).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.5 * sum(sizes)


def test_functions_compose():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, len(RUNS.table), 777)
    maps = RUNS.table[codes]
    whole = composed(maps)
    for s in range(len(RUN_STATES)):
        at = s
        for m in maps:
            at = m[at]
        assert whole[s] == at


SERIES = "k string, at long, v double, s double"


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(6)
    rows, clock = [], {}
    for i in range(4000):
        k = rng.choice(["hot", "hot", "hot", "warm", None, f"k{rng.randrange(400)}"])
        clock[k] = clock.get(k, 0.0) + rng.choice([0.0, 1.0, 2.5])
        rows.append((k, i, float(rng.randrange(50)), clock[k]))
    return rows, spark.createDataFrame(rows, SERIES).repartition(6).cache()


def by_key(rows):
    out = {}
    for k, at, v, s in rows:
        out.setdefault(k, []).append((at, v, s))
    return {k: sorted(x) for k, x in out.items()}


def result(df, name):
    return {(r.k, r.at): r[name] for r in df.collect()}


def test_medians_of_a_crowded_key(series):
    rows, df = series
    want = {}
    for k, x in by_key(rows).items():
        for i, (at, _, _) in enumerate(x):
            held = sorted(v for _, v, _ in x[max(0, i - 2) : i + 1])
            want[k, at] = held[len(held) // 2]
    assert result(T.rolling_median(df, "k", ["at"], "v"), "median") == want


def test_rates_and_busy_shares_of_a_crowded_key(series):
    rows, df = series
    rate, busy = {}, {}
    for k, x in by_key(rows).items():
        for i, (at, v, s) in enumerate(x):
            gap = s - x[i - 1][2] if i else 0
            rate[k, at] = max(0.0, (v - x[i - 1][1]) / gap) if gap > 0 else None
            busy[k, at] = round(max(0.0, min(100.0, (1 - (v - x[i - 1][1]) / gap) * 100)), 2) if gap > 0 else None
    assert result(T.rates(df, "k", ["at"], "v", F.col("s")), "rate") == rate
    assert result(T.cpu_percent(df, "k", ["at"], "s", "v"), "percent") == busy


def test_power_drops_its_baseline_after_a_reset(spark, series):
    rows, df = series
    want = {}
    for k, x in by_key(rows).items():
        base = None
        for at, v, s in x:
            watts, previous, base = None, base, (v, s)
            if previous and s > previous[1]:
                if v < previous[0]:
                    base = None
                else:
                    watts = (v - previous[0]) / (s - previous[1]) / 1e6
            want[k, at] = watts
    assert result(T.power(df, "k", ["at"], "v", F.col("s")), "watts") == want
    few = spark.createDataFrame([("a", 1, 9.0, 1.0), ("a", 2, 5.0, 2.0), ("a", 3, 3.0, 3.0), ("a", 4, 1000003.0, 4.0)], SERIES)
    assert result(T.power(few, "k", ["at"], "v", F.col("s")), "watts") == {("a", 1): None, ("a", 2): None, ("a", 3): None, ("a", 4): 1.0}


def test_running_sums_of_a_crowded_key(series):
    rows, df = series
    want = {}
    for k, x in by_key(rows).items():
        total = 0.0
        for at, v, _ in x:
            total += v
            want[k, at] = total
    assert result(ranges.running_sum(df, "k", ["at"], "v", "total"), "total") == want


def test_halos_reach_over_short_ranges(spark):
    rows = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(7)], SERIES)
    ranged = rows.withColumn(ranges.PART, F.col("at").cast("int"))  # one row in each range
    held = ranges.with_halo(ranged, "k", ["at"], 2).where(ranges.HALO).select(ranges.PART, "at")
    assert sorted(map(tuple, held.collect())) == sorted((p, a) for p in range(7) for a in (p - 2, p - 1) if a >= 0)


def order_statistics(rows, share):
    groups = {}
    for g, v in rows:
        if g is not None and v is not None:
            groups.setdefault(g, []).append(v)
    return {g: sorted(v)[max(1, int(np.ceil(len(v) * share))) - 1] for g, v in groups.items()}


@pytest.mark.parametrize(("share", "steps", "fits"), [(0.0, 1000, 1000), (0.999, 1000, 1000), (0.5, 1000, 1000), (1.0, 1000, 1000), (0.37, 20, 200)])
def test_order_statistics_of_odd_values(spark, share, steps, fits):
    rng = random.Random(9)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(6_000)] + [("hot", 1e300), ("hot", -1e300)]  # outliers
    rows += [("tied", 5.0)] * 3000 + [("tied", 6.0)] * 3 + [("one", 2.5), ("nothing", None), (None, 1.0)] + [(f"g{i % 50}", float(i % 7)) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "cell string, score double").repartition(4).cache()
    assert {r.cell: r.value for r in C.order_statistic(df, "cell", "score", share, steps, fits).collect()} == order_statistics(rows, share)
