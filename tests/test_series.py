"""Order statistics, recurrences over slices, as-of joins, planned sorts and time scales, against plain loops."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickspark.functions import times
from tickspark.operators import asof, clean, filters, planned_sort

TICK = "sym string, idx int, ts timestamp_ntz, ttf int, px decimal(18,4), sz decimal(18,4), seq long"
START = dt.datetime(2024, 1, 1)


def some(n, seed=1, days=5, symbols=("A", "B", None)):
    rng = random.Random(seed)
    from decimal import Decimal

    stamp = lambda: START + dt.timedelta(seconds=rng.randint(0, days * 86_400))
    return [(rng.choice(symbols), rng.choice([None, 1, 2]), rng.choice([stamp(), START]), rng.randint(0, 3), Decimal(rng.randint(1, 50)), Decimal(rng.randint(0, 9)), i) for i in range(n)]


def in_order(rows):
    none = lambda x: (x is not None, x)
    return sorted(rows, key=lambda r: (none(r[2]), none(r[1]) if r[1] is not None else (False, 0), r[3], r[6]))


@pytest.mark.parametrize("few, ranges", [(10_000, 4096), (5, 4), (1, 2)])
def test_a_tick_by_its_place(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(filters, "FEW", few)
    monkeypatch.setattr(filters, "RANGES", ranges)
    rows = [*some(60), ("A", 1, None, 1, None, None, 900), ("A", 1, None, 1, None, None, 901)]
    df = spark.createDataFrame(rows, TICK).coalesce(1).cache()
    want = in_order(rows)
    for place in (0, 1, 2, 31, len(rows) - 1) if few > 100 else (0, 2, 40):
        assert [tuple(r) for r in filters.at(df, place).collect()] == [want[place]]
    assert filters.at(df, len(rows)).count() == filters.at(df, -1).count() == 0


def test_running_offsets_over_slices(spark):
    rows = [r for r in some(400, 3, 20, ("A", "B")) if r[6] % 9] + [("C", 1, START, 1, None, None, 5000)]
    got = {r["seq"]: r["offset_us"] for r in clean.receive_lag(spark.createDataFrame(rows, TICK).withColumn("lag_us", F.col("px"))).collect()}
    want, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[6])):
        if r[4] is not None:
            state[r[0]] = (state.get(r[0], 0.0) + float(r[4])) / 2
        want[r[6]] = state.get(r[0], 0.0)
    assert got == pytest.approx(want, rel=1e-12)
    plan = clean.receive_lag(spark.createDataFrame(rows, TICK).withColumn("lag_us", F.col("px")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sym" in plan and "_slice" in plan


def test_quotes_at_trades(spark):
    rows = some(500, 4)
    df = spark.createDataFrame(rows, TICK)
    got = {r["seq"]: (r["q_ts"], r["q_px"], r["q_sz"]) for r in asof.as_of(df.where("ttf = 3"), df.where("ttf = 1")).collect()}
    want = {}
    for t in (r for r in rows if r[3] == 3):
        before = [q for q in rows if q[3] == 1 and q[0] == t[0] and q[0] is not None and q[2] <= t[2]]
        q = max(before, key=lambda q: (q[2], q[6]), default=None)
        if t[0] is not None:
            want[t[6]] = (q[2], q[4], q[5]) if q else (None, None, None)
    assert {k: v for k, v in got.items() if k in want} == want
    assert len(got) == sum(r[3] == 3 for r in rows)


def test_only_files_that_overlap_are_written_anew(spark, tmp_path):
    at = tmp_path / "store"
    write = lambda rows, ordered=True: (spark.createDataFrame(in_order(rows) if ordered else rows, TICK).coalesce(1).write.mode("append").parquet(str(at)))
    day = lambda d, n, seed: [(r[0], r[1] or 1, START + dt.timedelta(days=d, seconds=i), *r[3:6], seed * 1000 + i) for i, r in enumerate(some(n, seed))]
    groups = [day(0, 30, 1), day(10, 30, 2), day(5, 30, 3), day(10, 30, 4), day(20, 30, 5)]
    for rows in groups:
        write(rows)
    backwards = day(30, 30, 6)[::-1]
    write(backwards, ordered=False)
    lone = {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in at.glob("*.parquet")}
    every = [tuple(r) for r in spark.read.parquet(str(at)).orderBy(*planned_sort.ORDER).collect()]
    kept, replaced = planned_sort.sort_store(spark, str(at))
    assert (len(kept), len(replaced)) == (3, 3)
    for f in kept:
        name = Path(f.removeprefix("file:")).name
        assert lone[name] == ((at / name).stat().st_mtime_ns, (at / name).read_bytes())
    assert not [p for p in at.iterdir() if p.name.startswith("_sorted")]
    assert [tuple(r) for r in spark.read.parquet(str(at)).orderBy(*planned_sort.ORDER).collect()] == every
    ranges = planned_sort.plan(planned_sort.file_ranges(spark, str(at)))
    assert ranges.where("rewrite").count() == 0
    assert planned_sort.sort_store(spark, str(at))[1] == []
    # Files one after the other are the sorted table.
    files = [r["file"] for r in ranges.orderBy("lo").select("file").collect()]
    assert [tuple(r) for f in files for r in spark.read.parquet(f).collect()] == every


def test_time_scales_over_each_leap_second(spark):
    seconds = [s + d for s in times.LEAP_SECONDS for d in (-2, -1, 0, 1, 2)] + [0, 1_700_000_000]
    df = spark.createDataFrame([(s,) for s in seconds], "s long")
    out = df.select("s", times.to_tai(F.col("s")).alias("tai"), times.to_gps(F.col("s")).alias("gps")).withColumns({"back": times.from_tai(F.col("tai")), "again": times.from_gps(F.col("gps")), "leap": times.is_leap(F.col("tai"))}).collect()
    for r in out:
        offset = 9 + sum(r["s"] >= x for x in times.LEAP_SECONDS)
        assert (r["tai"], r["gps"], r["back"], r["again"], r["leap"]) == (r["s"] + offset, r["s"] + offset - 19 - 315964800, r["s"], r["s"], False)
    # Every TAI second from one before to one after each leap: UTC doesn't go back, and repeats in the leap second only.
    tai = [(s + 9 + k + d,) for k, s in enumerate(times.LEAP_SECONDS) for d in (-1, 0, 1)]
    rows = spark.createDataFrame(tai, "t long").select("t", times.from_tai(F.col("t")).alias("u"), times.is_leap(F.col("t")).alias("leap")).collect()
    for k, s in enumerate(times.LEAP_SECONDS):
        assert [(r["u"], r["leap"]) for r in rows[3 * k : 3 * k + 3]] == [(s - 1, False), (s - 1, True), (s, False)]


def test_patterns_of_stamps(spark):
    cases = [("2024-3-05", "%Y-%m-%d", dt.datetime(2024, 3, 5)), ("5-03-2024", "%d-%m-%Y", dt.datetime(2024, 3, 5)), ("2024-03-05 at 7:08:09", "%Y-%m-%d at %H:%M:%S", dt.datetime(2024, 3, 5, 7, 8, 9)), ("2024-13-05", "%Y-%m-%d", None), ("x", "%Y", None), (None, "%Y-%m-%d", None)]
    for text, pattern, want in cases:
        assert spark.createDataFrame([(text,)], "s string").select(times.parse_as(F.col("s"), pattern)).first()[0] == want
    with pytest.raises(ValueError, match="pattern"):
        times.parse_as(F.lit("x"), "%q")
