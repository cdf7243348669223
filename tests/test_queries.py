"""Every query with SQL gives what DuckDB gives, and names its columns alike."""

import os
import time

import pytest

import __spark_entry__ as entry
from cliploom.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert got == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_record_lookup_has_no_upper_bound(spark, tmp_path):
    n = (1 << 20) + 50
    spark.range(n).selectExpr("id AS vec_id", "CAST(id % 10 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    r = QUERIES["record_lookup"](spark, str(tmp_path)).selectExpr("count(*) AS n", "max(record_key) AS last").first()
    assert (r.n, r.last) == (n, n - 1)


def test_sql_functions_take_linear_time(spark):
    """The peak is computed once a row: clips of 44,100 samples take no more than some seconds."""
    from cliploom.functions import expr

    expr.register_sql(spark)
    clips = spark.range(8).selectExpr("array(transform(sequence(1, 44100), x -> cast(sin(x * (id + 1)) * 3 as float))) AS a")
    start = time.perf_counter()
    tops = [r.p for r in clips.selectExpr("clip_peak(clip_rescale(a)) AS p").collect()]
    assert all(abs(p - 1) < 1e-6 for p in tops) and time.perf_counter() - start < 20


def test_entry(spark):
    assert entry.entry(spark).count() == 10 or entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
