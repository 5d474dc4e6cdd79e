"""Every core query with SQL gives the same rows as DuckDB on the same files."""

import glob
import math
import os

import duckdb
import pytest

from trailmill.plans import registry


def norm(v):
    if v is None:
        return "N"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*columns).collect())
    if name in registry.SQL:
        r = duck.sql(registry.SQL[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
