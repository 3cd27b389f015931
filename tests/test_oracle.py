"""Every query with an SQL twin equals it in DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

from aerolith.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return float(v) if hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    out = duck.execute(SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(norm(r[columns.index(c)]) for c in names) for r in out.fetchall()), key=repr)


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
