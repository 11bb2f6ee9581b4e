"""What the plans must look like."""

import pytest

from tickspark.adapters import ticks
from tickspark.operators import candles, filters, sets
from tickspark.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(filters.grep(ticks(spark, sf), start="2024-01-05", end="2024-01-06").select("ts", "px"))
    assert "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in p


def test_one_shuffle_per_candle_query(spark, sf):
    assert plan(candles.candles(ticks(spark, sf), 86400)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("stream_", "source_", "container_"))))
def test_no_python_in_plans(spark, sf, name):
    p = plan(queries.QUERIES[name](spark, sf))
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p
    assert "CartesianProduct" not in p


def test_point_access_sorts_one_range_only(spark, sf, monkeypatch):
    assert "TakeOrderedAndProject" in plan(filters.at(ticks(spark, sf), 5))
    monkeypatch.setattr(filters, "FEW", 20)
    monkeypatch.setattr(filters, "RANGES", 16)
    p = plan(filters.at(ticks(spark, sf), 500))
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p
    assert sets.distinct_union(ticks(spark, sf), ticks(spark, sf)).count() == ticks(spark, sf).distinct().count()
