"""Rules of plans against literal cases, and spans of beats."""

import random

import pytest
from pyspark.sql import functions as F

from robustlake.operators import planning as P
from robustlake.streaming.heartbeats import joined_spans, silences_so_far


def test_motions_count_once_and_identity_not_at_all(spark):
    names = ["3d_viewpoint_rerendering_swipe_point", "3d_viewpoint_rerendering_swipe_ahead", "3d_viewpoint_rerendering_rotate_forward_x1_point", "identity", "jpeg", "rotate_point", "3d_viewpoint_rerendering_spin_point"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "method string, at int")
    assert df.agg(F.countDistinct(P.attack_type(F.col("method")))).first()[0] == 5
    got = {r.alias: r.at for r in P.alias_rows(df, "method", "at").collect()}
    assert got == {"3d_viewpoint_rerendering_swipe": 0, "3d_viewpoint_rerendering_rotate_forward": 2}


def test_the_identity_is_there_once(spark):
    df = spark.createDataFrame([("a", "jpeg"), ("a", "jpeg"), ("b", "identity")], "config string, attack string")
    assert sorted(map(tuple, P.with_baseline(df, "config", "attack").collect())) == [("a", "identity", True), ("a", "jpeg", False), ("b", "identity", False)]


def test_unknown_ids_are_refused(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 9), ("a", 8), ("b", 2)], "config string, dataset int")
    known = spark.createDataFrame([(1,), (2,), (2,)], "dataset int")
    assert sorted(map(tuple, P.checked(asked, known, "config", "dataset").collect())) == [("a", 3, 2, "8, 9"), ("b", 1, 0, "")]
    with pytest.raises(ValueError, match="a: unknown dataset 8, 9"):
        P.require_known(asked, known, "config", "dataset")
    P.require_known(asked.where("config = 'b'"), known, "config", "dataset")


def parent(spark, shards, units):
    own = spark.createDataFrame([(1, *s) for s in shards], "run_id int, status string, expected int, error string")
    done = spark.createDataFrame([(1, u) for u in units], "run_id int, status string")
    return P.parent_status(own, done).first().status


def test_status_of_a_parent_run(spark):
    ok = ("succeeded", 1, None)
    assert parent(spark, [ok, ok], ["succeeded", "succeeded"]) == "succeeded"
    assert parent(spark, [ok, ("cancelled", 1, "e"), ("paused", 1, None)], []) == "cancelled"
    assert parent(spark, [ok, ("paused", 1, "e")], ["succeeded"]) == "paused"
    assert parent(spark, [ok, ("failed", 1, "e")], ["succeeded"]) == "partially_failed"
    assert parent(spark, [("failed", 1, "e")], []) == "failed"
    assert parent(spark, [ok, ok], ["succeeded"]) == "partially_failed"
    assert parent(spark, [ok, ok], ["succeeded", "failed"]) == "partially_failed"
    assert parent(spark, [ok], ["failed"]) == "failed"


def test_selections_fall_back_to_defaults(spark):
    rows = [('{"datasetIds": ["x", "y"], "maxSamples": 3, "seeds": [5, null]}', (["x", "y"], 3, [5])), ("{}", (["first"], 1, [42])), ('{"maxSamples": "abc", "datasetIds": 3}', (["first"], 1, [42])), (None, (["first"], 1, [42]))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: tuple(r.x) for r in df.select("i", P.selection(F.col("t"), F.array(F.lit("first"), F.lit("second"))).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_packs_are_ready_once_every_marker_is_there(spark):
    required = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "pack string, path string")
    listed = spark.createDataFrame([("x", 5), ("y", 0), ("z", 1), ("other", 1)], "path string, length long")
    assert sorted(map(tuple, P.packs_ready(required, listed).collect())) == [("a", 2, 1, False), ("b", 1, 0, True), ("c", 1, 0, True)]


def test_spans_join_whatever_their_order():
    rng = random.Random(1)
    for _ in range(300):
        beats = sorted(rng.randrange(100) for _ in range(rng.randrange(1, 25)))
        want = joined_spans([(b, b, 1) for b in beats], 5)
        shuffled, spans = rng.sample(beats, len(beats)), []
        while shuffled:
            some = [shuffled.pop() for _ in range(min(len(shuffled), rng.randrange(1, 4)))]
            spans = joined_spans([*spans, *((b, b, 1) for b in some)], 5)
        assert spans == want and sum(s[2] for s in spans) == len(beats)
        assert all(b[0] - a[1] > 5 for a, b in zip(spans, spans[1:]))


def test_a_run_with_fresh_beats_is_not_paused(spark):
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    rows = [(1, at(m)) for m in range(0, 40, 2)] + [(2, at(0)), (2, at(1)), (2, at(20))] + [(3, at(38))]
    beats = spark.createDataFrame(rows, "run_id long, t string").select("run_id", F.col("t").cast("timestamp").alias("ts"))
    got = sorted((r.run_id, str(r.last_seen)[14:16], str(r.paused_at)[14:16], r.beats) for r in silences_so_far(beats, 300, 60).collect())
    assert got == [(2, "01", "06", 2), (2, "20", "25", 1)]
