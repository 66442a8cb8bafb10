"""Every registered query of the analytics part against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from robustlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 9) + 0.0 if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, base, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = base.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == want


def test_sizes_beyond_a_thousand_gigabytes_equal_sql(spark, base, tmp_path):
    keys = [1, 7, 5_387, 170_000, 172_387, 900_000, None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(keys)], "o_orderkey long, o_custkey long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted((r.o_orderkey, r["size"]) for r in QUERIES["f20_byte_size"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["f20_byte_size"]).fetchall())
