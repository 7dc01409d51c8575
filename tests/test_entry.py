"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return round(float(value), 6) if isinstance(value, float) else value

    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", entry_points.queries())
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    sql = entry_points.oracle_sql().get(name)
    if sql is not None:
        result = duck.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["metric", "base", "candidate", "delta", "ratio"]
