"""Every core query against its SQL on the smallest data."""

import math
import os

import duckdb
import pytest

from glyphmill.plans import catalogue


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None))
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    rel = duck.sql(catalogue.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
