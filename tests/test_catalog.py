"""Every query against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioframe.plans import catalog


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v)
    return str(v.tolist()) if hasattr(v, "tolist") else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
