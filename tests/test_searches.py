"""Samples, overlapping sets and the search for a best candidate."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from robustlake.operators import overlaps as O
from robustlake.operators import sampling as S
from robustlake.operators import tuning as T
from robustlake.storage import scratch


def test_samples_without_replacement_are_the_smallest_hashes(spark):
    pool = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("n"))
    hashes = {r.k: r.h for r in pool.select("k", S.order_of(7, F.col("k")).alias("h")).collect()}
    want = sorted(hashes, key=lambda k: (hashes[k], k))
    for n in (0, 1, 40, 5000):
        assert sorted(r.k for r in S.without_replacement(pool, "k", n, 7).collect()) == sorted(want[:n])
    assert [r.k for r in S.sampled(pool.repartition(9), "k", 40, 7).orderBy("draw").collect()] == want[:40]


def test_a_pool_smaller_than_the_sample_is_drawn_with_replacement(spark):
    pool = spark.range(10).select(F.col("id").alias("k"))
    got = S.sampled(pool, "k", 5000, 7).collect()
    assert sorted(r.draw for r in got) == list(range(5000))
    times = Counter(r.k for r in got)
    assert set(times) == set(range(10)) and min(times.values()) > 400 and max(times.values()) < 600
    again = {r.draw: r.k for r in S.sampled(pool.repartition(3), "k", 5000, 7).collect()}
    assert again == {r.draw: r.k for r in got}
    assert {r.draw: r.k for r in S.sampled(pool, "k", 5000, 8).collect()} != again
    with pytest.raises(ValueError, match="nothing"):
        S.sampled(pool.limit(0), "k", 1, 7)


@pytest.mark.parametrize("part", [512, 5])
def test_packs_that_share_a_marker(spark, monkeypatch, part):
    monkeypatch.setattr(O, "PART", part)
    rng = random.Random(2)
    rows = [(rng.choice(["d1", "d2", None]), f"p{i}", m) for i in range(70) for m in rng.sample(range(40), rng.randrange(1, 4))]
    rows += [("d1", f"p{i}", 99) for i in range(0, 70, 2)] + [("d1", "p0", 99), ("d1", "p3", None)]  # a crowded marker, a row twice
    sets = {}
    for d, p, m in rows:
        sets.setdefault((d, p), set()).update({m} - {None})
    want = sorted((str(d), p, q) for (d, p), a in sets.items() for (e, q), b in sets.items() if d == e and p < q and a & b)
    got = O.sharing(spark.createDataFrame(rows, "dir string, pack string, marker int"), "dir", "pack", "marker").collect()
    assert sorted((str(r.dir), r.pack, r.other) for r in got) == want


def candidates(spark):
    return spark.createDataFrame([("a", c) for c in (1, 2, 4)] + [("b", c) for c in (1, 2, 4, 8, 16, 32)] + [("broken", 1)], "item string, candidate long")


def measure(log):
    def work(asked):
        log.extend(sorted(map(tuple, asked.collect())))
        rate = F.when(F.col("samples") < 6, F.col("candidate")).otherwise(10 - F.abs(F.col("candidate") - 4)).cast("double")  # short probes mislead
        return asked.withColumns({"rate": rate, "ok": F.col("item") != "broken"})

    return work


def test_all_are_probed_and_finalists_measured_again(spark):
    log = []
    found = T.Search(spark, scratch(spark, "search").path, measure(log)).run(candidates(spark), 10)
    assert [x for x in log if x[0] == "a"][:3] == [("a", 1, 3), ("a", 2, 6), ("a", 4, 10)]
    assert sorted(map(tuple, found.select("item", "candidate", "samples").collect())) == [("a", 4, 10), ("b", 4, 10)]
    assert len(log) == len(set(log))  # nothing is measured twice


def test_a_search_resumes_after_its_driver_is_lost(spark):
    path, log = scratch(spark, "search").path, []

    def dies(asked):
        if log:
            raise RuntimeError("lost")
        return measure(log)(asked)

    with pytest.raises(RuntimeError, match="lost"):
        T.Search(spark, path, dies).run(candidates(spark), 40)
    probes = list(log)
    found = T.Search(spark, path, measure(log)).run(candidates(spark), 40)
    assert len(log) == len(set(log)) and log[: len(probes)] == probes
    assert sorted(map(tuple, found.select("item", "candidate", "samples").collect())) == [("a", 4, 40), ("b", 4, 40)]
