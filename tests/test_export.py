"""Exports that appear whole or not at all."""

import pytest
from pyspark.sql import functions as F

from robustlake.sources import export as X
from robustlake.sources.writers import csv_lines
from robustlake.storage import scratch


def tables(spark, n, broken=False):
    own = spark.range(n, numPartitions=4).select("id", F.concat(F.lit('a"'), F.col("id")).alias("name"))
    if broken:
        own = own.withColumn("name", F.when(F.col("id") == n - 1, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    return {"big.csv": csv_lines(own, ["id", "name"], ["id"]), "few.csv": csv_lines(own.where("id < 2"), ["name"], ["id"], F.lit("the end"))}


def lines(spark, path):
    found = {}
    for r in X.read_export(spark, path).collect():
        found.setdefault(r.file, {})[r.at] = r.line
    return {f: [x[i] for i in range(len(x))] for f, x in found.items()}


def test_files_of_an_export_appear_together_in_order(spark):
    path = scratch(spark, "export").path
    X.write_export(tables(spark, 50), path)
    want = {"big.csv": ['"id","name"', *[f'"{i}","a""{i}"' for i in range(50)]], "few.csv": ['"name"', '"a""0"', '"a""1"', "", "the end"]}
    assert lines(spark, path) == want
    with pytest.raises(Exception, match="lost"):
        X.write_export(tables(spark, 60, broken=True), path)
    assert lines(spark, path) == want
    files, root = X._store(path)
    assert [i.base_name for i in files.get_file_info(X.fs.FileSelector(root))] == ["export-000001"]
    X.write_export(tables(spark, 3), path)
    assert len(lines(spark, path)["big.csv"]) == 4


def test_no_export_is_an_error(spark):
    with pytest.raises(Exception, match="no complete export"):
        X.read_export(spark, scratch(spark, "export").path).collect()


def test_exports_meet_the_cells_once(spark, monkeypatch):
    from robustlake.plans import search_queries as Q

    seen, own = spark.sparkContext.accumulator(0), Q.cells

    @F.udf("string")
    def met(key):
        seen.add(1)
        return key

    def counted(s, d):
        return own(s, d).withColumn("attack_id", met("attack_id"))

    total = own(spark, "/root/testdata/sf0.001").count()
    monkeypatch.setattr(Q, "cells", counted)
    assert Q.exports(spark, "/root/testdata/sf0.001").count() > 0 and seen.value == total
