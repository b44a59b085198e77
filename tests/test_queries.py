import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrion.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_matches_its_sql(spark, duck, key):
    df = QUERIES[key](spark, SF)
    if key not in ORACLE:
        assert df.count() == 7
        return
    want = duck.sql(ORACLE[key])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "n", "mean"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
