"""Every query that has SQL gives the same rows as DuckDB does on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    ref = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert len(rows) == len(ref)
    assert all(same(x, y) for r, s in zip(rows, ref) for x, y in zip(r, s))


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
