"""OHLC candles: one shuffle on (sym, side, bucket), order by keys and never by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.functions.times import bucket_end
from tickspark.schema import ASK, BID, TRA, key

SIDES = (BID, ASK, TRA)


def candles(ticks: DataFrame, length: int = 300, modulus: int = 0, sides: tuple[int, ...] = SIDES, zero_fill: bool = False) -> DataFrame:
    """(sym, side, ts, sta_ts, o, h, l, c, cnt) of each bucket [ts - length, ts), stamped at its end.

    A side without ticks has no row; with zero_fill a bid or ask whose other side
    has ticks gets a candle of zeros.
    """
    rows = ticks.where(F.col("ttf").isin(list(sides)) & F.col("px").isNotNull())
    end = bucket_end(F.col("ts"), length, modulus)
    out = rows.groupBy("sym", F.col("ttf").alias("side"), end.alias("end")).agg(
        F.min_by("px", key()).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", key()).alias("c"), F.count("*").alias("cnt")
    )
    out = out.select("sym", "side", F.col("end").alias("ts"), (F.col("end") - F.make_dt_interval(secs=F.lit(length))).alias("sta_ts"), "o", "h", "l", "c", "cnt")
    return _zero_filled(out) if zero_fill else out


def _zero_filled(out: DataFrame) -> DataFrame:
    quotes = out.where(F.col("side").isin(BID, ASK)).groupBy("sym", "ts", "sta_ts").agg(F.collect_set("side").alias("have"))
    idle = quotes.where(F.size("have") == 1).select("sym", (F.lit(BID + ASK) - F.col("have")[0]).alias("side"), "ts", "sta_ts", *(F.lit(0).cast(out.schema[c].dataType).alias(c) for c in ("o", "h", "l", "c")), F.lit(0).cast("long").alias("cnt"))
    return out.unionByName(idle)


def _sided(rows: DataFrame) -> DataFrame:
    """Bid and ask prices of a row as two rows."""
    sides = F.array(F.struct(F.lit(BID).alias("ttf"), F.col("bp").alias("px")), F.struct(F.lit(ASK).alias("ttf"), F.col("ap").alias("px")))
    return rows.select("sym", "ts", "seq", F.inline(sides)).where(F.col("px").isNotNull())


def candles_of_pairs(pairs: DataFrame, length: int = 300, modulus: int = 0) -> DataFrame:
    """Both sides from bid-ask pairs."""
    return candles(_sided(pairs), length, modulus)


def candles_of_snapshots(snapshots: DataFrame, length: int = 300, modulus: int = 0) -> DataFrame:
    """Both sides from snapshots; a snapshot spans time, so one on the dot belongs to the bucket that ends there."""
    rows = _sided(snapshots.where((F.col("bp") != 0) | (F.col("ap") != 0))).where("px <> 0")
    return candles(rows.withColumn("ts", F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")), length, modulus)


def roll_up(rows: DataFrame, length: int, modulus: int = 0) -> DataFrame:
    """Longer candles from shorter ones: buckets (ts - length, ts]; idle candles (cnt 0) don't count."""
    end = bucket_end(F.col("ts"), length, modulus, closed_end=True)
    order = F.struct("ts", "sta_ts")
    return rows.where("cnt > 0").groupBy("sym", "side", end.alias("end")).agg(
        F.min_by("sta_ts", order).alias("sta_ts"), F.min_by("o", order).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", order).alias("c"), F.sum("cnt").alias("cnt")
    ).select("sym", "side", F.col("end").alias("ts"), "sta_ts", "o", "h", "l", "c", "cnt")


def join_candles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candles of the same sym, side and ts from two sets as one."""
    order = F.struct("sta_ts", "_set")
    both = a.withColumn("_set", F.lit(0)).unionByName(b.withColumn("_set", F.lit(1)))
    return both.groupBy("sym", "side", "ts").agg(F.min("sta_ts").alias("sta_ts"), F.min_by("o", order).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", order).alias("c"), F.sum("cnt").alias("cnt"))


def pivot_sides(rows: DataFrame) -> DataFrame:
    """One row per (sym, ts): prices of bid, ask and trade side by side."""
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    names = {BID: "b", ASK: "a", TRA: "t"}
    return rows.groupBy("sym", "ts").agg(*(at(s, c).alias(f"{n}_{c}") for s, n in names.items() for c in ("o", "h", "l", "c")))


def volume_candles(ticks: DataFrame, length: int = 300, modulus: int = 0) -> DataFrame:
    """(sym, ts, vol, vwap, twap, cnt) of trades: volume, price by volume and plain mean price."""
    from tickspark.functions.decimals import vwap

    rows = ticks.where((F.col("ttf") == TRA) & F.col("px").isNotNull())
    mean = (F.call_function("div", F.sum((F.col("px") * 10_000).cast("bigint")), F.count("*")) / F.lit(10_000)).cast("decimal(18,4)")
    return rows.groupBy("sym", bucket_end(F.col("ts"), length, modulus).alias("ts")).agg(F.sum(F.col("sz").cast("decimal(18,4)")).alias("vol"), vwap(F.col("px"), F.col("sz")).alias("vwap"), mean.alias("twap"), F.count("*").alias("cnt"))
