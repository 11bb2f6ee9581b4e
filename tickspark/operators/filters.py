"""Selections and projections of ticks; all are plain predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.schema import ASK, ASK2, BID, BID2, CANDLE, QUAD, SNAPSHOT, key


def by_symbol(ticks: DataFrame, symbols: Iterable[str]) -> DataFrame:
    return ticks.where(F.col("sym").isin(list(symbols)))


def by_index(ticks: DataFrame, indices: Iterable[int]) -> DataFrame:
    return ticks.where(F.col("idx").isin(list(indices)))


def by_symbol_or_index(ticks: DataFrame, symbols: Iterable[str], indices: Iterable[int]) -> DataFrame:
    """Either selection lets a tick pass."""
    return ticks.where(F.col("sym").isin(list(symbols)) | F.col("idx").isin(list(indices)))


def _stamp(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def by_time(ticks: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """[start, end) in UTC; either end may be open."""
    if start is not None:
        ticks = ticks.where(F.col("ts") >= _stamp(start))
    return ticks if end is None else ticks.where(F.col("ts") < _stamp(end))


def by_day(ticks: DataFrame, day: str) -> DataFrame:
    return ticks.where((F.col("ts") >= _stamp(day)) & (F.col("ts") < _stamp(day) + F.expr("INTERVAL 1 DAY")))


def grep(ticks: DataFrame, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """All ticks in an interval, of some instruments."""
    return by_time(ticks if symbols is None else by_symbol(ticks, symbols), start, end)


def symbols_of(ticks: DataFrame) -> DataFrame:
    """The dictionary that a selection needs."""
    return ticks.select("idx", "sym").distinct()


#: Ranges of a histogram, and how many rows may be sorted to end a search.
RANGES, FEW = 4096, 10_000


def at(ticks: DataFrame, place: int) -> DataFrame:
    """The tick at a 0-based place in chronological order.

    Not a sort up to that place: histograms of the order's columns, one after the
    other, narrow down the range that holds it, and only what is left is sorted.
    A range's bounds are predicates, so the scan skips what lies outside.  Each
    histogram has at most RANGES rows, which the driver sees; ranges of ever finer
    width end at one value, so a search takes six rounds a column at most.
    """
    nothing = ticks.limit(0)
    if place < 0:
        return nothing
    rows = ticks
    for column in ("ts", "idx", "ttf", "seq"):
        value = F.unix_micros(F.col(column).cast("timestamp")) if column == "ts" else F.col(column).cast("bigint")
        bound = (lambda v: F.timestamp_micros(F.lit(v)).cast("timestamp_ntz")) if column == "ts" else F.lit
        span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"), F.count(F.col(column)).alias("some")).first()
        if place >= span["n"]:
            return nothing
        if span["n"] <= FEW:
            break
        nulls = span["n"] - span["some"]  # they come first
        if place < nulls:
            rows = rows.where(F.col(column).isNull())
            continue
        rows, place, lo, hi = rows.where(F.col(column).isNotNull()), place - nulls, span["lo"], span["hi"]
        n = span["some"]
        while lo < hi and n > FEW:
            width = -(-(hi - lo + 1) // RANGES)
            counts = sorted((r["k"], r["count"]) for r in rows.groupBy(F.floor((value - lo) / width).alias("k")).count().collect())
            for k, n in counts:  # noqa: B007
                if place < n:
                    break
                place -= n
            lo, hi = lo + k * width, min(hi, lo + (k + 1) * width - 1)
            rows = rows.where((F.col(column) >= bound(lo)) & (F.col(column) <= bound(hi)))
        if n <= FEW:
            break
    order = ("ts", "idx", "ttf", "seq")
    first = rows.orderBy(*order).limit(place + 1)
    return first.orderBy(*(F.desc(c) for c in order)).limit(1) if place < FEW else first.offset(place).limit(1)


def first_after(ticks: DataFrame, stamp: str) -> DataFrame:
    """Per symbol the first tick later than a stamp."""
    first = ticks.where(F.col("ts") > _stamp(stamp)).groupBy("sym").agg(F.min(key("ttf", "px", "sz")).alias("k"))
    return first.select("sym", "k.ts", "k.seq", "k.ttf", "k.px", "k.sz")


def proper(ticks: DataFrame) -> DataFrame:
    """Without markers."""
    return ticks.where(F.col("flow").isNull())


def is_market_order(sides: Iterable[int] = (BID, ASK)) -> Column:
    return F.coalesce(F.col("is_mkt"), F.lit(False)) & F.col("ttf").isin(list(sides))


def is_candle(ttf: Column) -> Column:
    return (ttf.bitwiseAND(F.lit(CANDLE)) != 0) & (ttf != SNAPSHOT)


def is_snapshot(ttf: Column) -> Column:
    return ttf == SNAPSHOT


def width(ttf: Column) -> Column:
    """Cells of 16 bytes that a tick of this type takes in the binary layout; 0 for the combination that isn't written."""
    two, four = ttf.bitwiseAND(F.lit(CANDLE)) != 0, ttf.bitwiseAND(F.lit(QUAD)) != 0
    return F.when(two & four, 0).when(four, 4).when(two, 2).otherwise(1)


def book(ticks: DataFrame, bid: int = BID2, ask: int = ASK2) -> DataFrame:
    """Level-2 book at the end: the last size of each price slot; a size of zero frees the slot."""
    last = ticks.where(F.col("ttf").isin(bid, ask)).groupBy("sym", "ttf", "px").agg(F.max_by("sz", key()).alias("sz"), F.max("ts").alias("ts"))
    return last.where("sz > 0")


def book_levels(ticks: DataFrame, depth: int, bid: int = BID2, ask: int = ASK2) -> DataFrame:
    """The best price levels of a book: highest bids, lowest asks."""
    best = Window.partitionBy("sym", "ttf").orderBy(F.when(F.col("ttf") == bid, -F.col("px")).otherwise(F.col("px")))
    return book(ticks, bid, ask).withColumn("level", F.row_number().over(best)).where(F.col("level") <= depth)
