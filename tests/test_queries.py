"""Every query of the entry points that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(SQL[name].replace("/root/testdata/sf0.01", DATA))
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
