"""The training-data queries that SQL can express, against their SQL on the smallest data."""

import os

import duckdb
import pytest

from glyphmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    duck = duckdb.connect()
    for f in os.listdir(small):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    df = queries.queries()[name](spark, small)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
