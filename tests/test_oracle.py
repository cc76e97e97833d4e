"""Every query with SQL gives the rows of its SQL in DuckDB."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, small, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=key)
    theirs = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({SQL[name]})").fetchall()
    assert ours == sorted((tuple(map(plain, r)) for r in theirs), key=key)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
