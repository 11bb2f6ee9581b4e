"""Queries that SQL can express, against it."""

import duckdb
import pytest

from tickspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
