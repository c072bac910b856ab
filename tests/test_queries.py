"""Every query of the catalog against DuckDB on the smallest tables."""

import datetime as d
from decimal import Decimal

import duckdb
import pytest

from sparkmart import catalog, evidence  # noqa: F401  it registers further queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float) or isinstance(v, Decimal):
        return round(float(v), 9)
    return v.isoformat() if isinstance(v, (d.date, d.datetime)) else v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
