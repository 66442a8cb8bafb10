"""Stores that outlive their process: kept scores, memo of steps, exports."""

import pytest
from pyspark.sql import functions as F

from robustlake.operators import kept as K
from robustlake.storage import scratch

ROWS = "unit string, attack_id string, strength double, nqd double, tpr double, samples int"


@pytest.fixture()
def place(spark):
    folder = scratch(spark, "test")
    yield folder
    folder.drop()


def write(spark, source, rows, mode="append"):
    df = spark.createDataFrame(rows, ROWS)
    df.repartition("unit").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(source)


def inputs(n, shift=0.0):
    return [(f"u {i}/{i % 3}" if i % 2 else f"u{i}", f"atk-{j % 2}", j / 4, 0.25 * j + shift, 0.5 + i / 100, (i + j) % 4) for i in range(n) for j in range(4)]


def points(df):
    return sorted((r.unit, r.attack_id, r.strength, round(r.nqd, 9), round(r.tpr, 9), r.samples) for r in df.collect())


def whole(spark, source):
    return points(K.merged_points(K.curve_sums(spark.read.parquet(source).withColumn("unit", F.col("unit").cast("string"))), "unit", "attack_id", "strength"))


def held(store):
    return points(K.merged_points(store.sums(), "unit", "attack_id", "strength"))


def test_an_update_of_one_input_reads_that_one(spark, place):
    source, read = f"{place.path}/source", []

    def partial(rows):
        read.append({r["unit"] for r in rows.select("unit").distinct().collect()})
        return K.curve_sums(rows)

    write(spark, source, inputs(120))
    store = K.Kept(spark, f"{place.path}/store", partial)
    assert store.refresh(source) == {"kept": 0, "read": 120, "dropped": 0}
    assert held(store) == whole(spark, source)
    restarted = K.Kept(spark, f"{place.path}/store", partial)
    assert restarted.refresh(source) == {"kept": 120, "read": 0, "dropped": 0} and len(read) == 1
    write(spark, source, [r for r in inputs(120, 0.5) if r[0] == "u 7/1"], "overwrite")
    assert restarted.refresh(source) == {"kept": 119, "read": 1, "dropped": 0}
    assert read[-1] == {"u 7/1"}
    assert held(restarted) == whole(spark, source)


def test_new_and_dropped_inputs(spark, place, monkeypatch):
    monkeypatch.setattr(K, "NAMED", 0)  # through the join
    source = f"{place.path}/source"
    write(spark, source, inputs(5))
    store = K.Kept(spark, f"{place.path}/store", K.curve_sums)
    store.refresh(source)
    write(spark, source, [r for r in inputs(7) if r[0] in ("u6", "u 5/2")])
    K.Folder(spark, source).drop("unit=u2")
    assert store.refresh(source) == {"kept": 4, "read": 2, "dropped": 1}
    assert held(store) == whole(spark, source)


def test_a_refresh_that_dies_leaves_the_store_as_it_was(spark, place):
    source = f"{place.path}/source"
    write(spark, source, inputs(6))
    store = K.Kept(spark, f"{place.path}/store", K.curve_sums)
    store.refresh(source)
    before = held(store)
    write(spark, source, [r for r in inputs(6, 0.25) if r[0] == "u4"], "overwrite")
    broken = K.Kept(spark, f"{place.path}/store", lambda rows: K.curve_sums(rows).withColumn("x", F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        broken.refresh(source)
    assert held(store) == before
    assert store.refresh(source) == {"kept": 5, "read": 1, "dropped": 0}
    assert held(store) == whole(spark, source)


def test_old_versions_are_folded_into_one(spark, place, monkeypatch):
    monkeypatch.setattr(K, "VERSIONS", 2)
    source = f"{place.path}/source"
    store = K.Kept(spark, f"{place.path}/store", K.curve_sums)
    for n in (2, 3, 4, 5, 6):
        write(spark, source, [r for r in inputs(n) if r[0] in {x[0] for x in inputs(n)} - {x[0] for x in inputs(n - 1)} or n == 2])
        store.refresh(source)
        assert held(store) == whole(spark, source)
    assert len([n for n in K.Folder(spark, f"{place.path}/store").names() if n.startswith("version=")]) <= 4


def test_a_step_sees_each_content_once(spark, place):
    from robustlake.operators.memo import Memo

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def length(text):
        seen.add(1)
        return len(text)

    rows = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}", "c") for i in range(90)] + [(90, None, "c"), (91, "", "c")], "id long, body string, n string")
    memo = Memo(spark, place.path, "long")
    first = memo.through(rows.where("id < 60"), "body", "length", {"unit": "chars", "base": 1}, length)
    assert seen.value == 21 and first.columns == ["id", "body", "n", "digest", "result", "reused"] and first.count() == 60
    again = {r.id: r for r in Memo(spark, place.path, "long").through(rows, "body", "length", {"base": 1, "unit": "chars"}, length).collect()}
    assert seen.value == 21 + 10 + 1
    assert len(again) == 92 and again[90].result is None and again[91].result == 0
    assert again[3].reused and again[61].reused and not again[63].reused
    assert all(r.result == len(r.body) for r in again.values() if r.body is not None)
    assert memo.known("length", {"unit": "bytes"}).isEmpty()


def test_a_step_that_fails_leaves_no_results(spark, place):
    from robustlake.operators.memo import Memo

    memo, rows = Memo(spark, place.path, "long"), spark.createDataFrame([("a",), ("b",)], "body string")
    with pytest.raises(Exception, match="lost"):
        memo.through(rows, "body", "length", {}, lambda c: F.raise_error(F.lit("lost")).cast("long"))
    assert memo.known("length", {}).isEmpty()
    assert sorted(r.result for r in memo.through(rows, "body", "length", {}, lambda c: F.length(c).cast("long")).collect()) == [1, 1]
    assert memo.known("length", {}).count() == 2


@pytest.mark.parametrize("named", [1000, 0])
@pytest.mark.parametrize("odd", [["a+b", "c}d{e", "f=g%h", "i:j?k*l", "é ü", "007", None], ["007", "7"]])
def test_inputs_of_odd_names(spark, place, monkeypatch, named, odd):
    monkeypatch.setattr(K, "NAMED", named)
    source = f"{place.path}/source"
    write(spark, source, [(u, "atk-0", 0.5, 0.25, 0.5, 2) for u in odd])
    store = K.Kept(spark, f"{place.path}/store", K.curve_sums)
    assert store.refresh(source) == {"kept": 0, "read": len(odd), "dropped": 0}
    assert store.refresh(source) == {"kept": len(odd), "read": 0, "dropped": 0}
    assert sorted(r.unit for r in store.sums().collect()) == sorted(u or K.NO_NAME for u in odd)
