"""Every query against its SQL on DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickspark.plans import queries


def plain(df: pd.DataFrame) -> list[tuple]:
    def show(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (float, np.floating)) else str(x)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got)
