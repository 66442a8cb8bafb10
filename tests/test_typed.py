"""Typed parameters against Python's own JSON."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from robustlake.functions import typed as Y


def dumps(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=True)


def some(rng, depth):
    kind = rng.randrange(9 if depth else 7)
    if kind == 7:
        return {rng.choice(["b", "a", "é", "key with space", "z\"q", "🙂"]): some(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 8:
        return [some(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [rng.randrange(-100, 100), rng.choice([0.5, 1.0, -2.25, 1e-7, 1e22, 123456789.5, 0.0001, 1e16, 3e15, 6.02e23, 100.0]), "plain", rng.choice(["é\n\"\\", "\u0001\t", "🙂ü", ""]), True, False, None][kind]


def test_canonical_text_is_that_of_python(spark):
    rng = random.Random(3)
    values = [some(rng, 3) for _ in range(150)] + [12345678901234567890, -7, {"a": {"b": [1, {"d": None}]}}]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", Y.canonical(F.parse_json("t")).alias("c")).collect()}
    for i, v in enumerate(values):
        assert got[i] == dumps(v), v


def test_floats_read_back(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 25) for _ in range(300)] + [0.0, -0.0, 1e15, 1e16, 9999999.0, 1e7, 0.001, 0.00001]
    got = [r.s for r in spark.createDataFrame([(x,) for x in xs], "x double").select(Y.json_float(F.col("x")).alias("s")).collect()]
    for x, s in zip(xs, got):
        assert float(s) == x and ("e" in s) == ("e" in repr(x))
    assert got[-8:] == ["0.0", "-0.0", "1000000000000000.0", "1e+16", "9999999.0", "10000000.0", "0.001", "1e-05"]


def test_variants_are_cleaned_and_kept_in_first_seen_order(spark):
    rows = [
        ("regen", 5, '{"name": "anchor", "quality": 3}'), ("regen", 2, '{"quality": 1, "name": "anchor"}'), ("regen", 1, '{"quality": 1e999}'),
        ("regen", 3, '{"unknown": null}'), ("regen", 4, '{"name": "anchor", "quality": 1, "gone": null, "list": [1], "nest": {"x": 1}}'),
        ("regen", 6, '{"name": "anchor", "quality": 1.0, "on": true}'), ("regen", 7, "[1]"), ("regen", 8, "3"), ("jpeg", 9, '{"q": "é"}'), ("jpeg", 10, None),
    ]
    df = spark.createDataFrame(rows, "m string, at int, t string")
    got = [tuple(r) for r in Y.variants(df, "m", F.parse_json("t"), "at").orderBy("method", "place").collect()]
    want = [("jpeg", 1, {"q": "é"}), ("regen", 1, {"name": "anchor", "quality": 1}), ("regen", 2, {"name": "anchor", "quality": 3}), ("regen", 3, {"name": "anchor", "quality": 1.0, "on": True})]
    assert got == [(m, k, dumps(v), hashlib.sha256(dumps(v).encode()).hexdigest()[:12]) for m, k, v in want]


def test_numbers_that_are_not_finite_go(spark):
    df = spark.createDataFrame([(math.nan, math.inf, 1.5)], "a double, b double, c double")
    obj = F.to_variant_object(F.struct("a", "b", "c"))
    assert df.select(Y.canonical_flat(Y.cleaned(obj)).alias("t")).first().t == '{"c": 1.5}'


def test_deeper_parameters_are_refused(spark):
    deep = json.dumps({"a": {"b": {"c": {"d": {"e": 1}}}}})
    with pytest.raises(Exception, match="nested deeper"):
        spark.createDataFrame([(deep,)], "t string").select(Y.canonical(F.parse_json("t"))).collect()


def test_variants_parse_each_text_once(spark):
    from robustlake.plans.typed_queries import param_variants

    plan = param_variants(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    parsed = [k for k, line in enumerate(plan) if "parse_json" in line or "parseJson" in line]
    assert parsed and max(k for k, line in enumerate(plan) if "Aggregate" in line) > max(parsed)  # below the step that parses
