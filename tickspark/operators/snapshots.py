"""Interval snapshots: last quotes and volume-weighted trade price per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.decimals import vwap
from tickspark.functions.times import bucket_end
from tickspark.schema import ASK, BID, PRICE, TRA, VOLUME, key


def snapshots(ticks: DataFrame, length: int = 300, modulus: int = 0) -> DataFrame:
    """(sym, ts, bp, bq, ap, aq, tvpr, tq) of each bucket [ts - length, ts); nothing is carried over from the bucket before."""
    side = lambda t: F.when(F.col("ttf") == t, key())
    last = lambda c, t: F.max_by(F.when(F.col("ttf") == t, F.col(c)), side(t))
    trade = lambda c: F.when(F.col("ttf") == TRA, F.col(c))
    rows = ticks.where(F.col("ttf").isin(BID, ASK, TRA) & F.col("px").isNotNull())
    return rows.groupBy("sym", bucket_end(F.col("ts"), length, modulus).alias("ts")).agg(
        last("px", BID).alias("bp"), last("sz", BID).alias("bq"), last("px", ASK).alias("ap"), last("sz", ASK).alias("aq"),
        vwap(trade("px"), trade("sz")).alias("tvpr"), F.sum(trade("sz")).cast(VOLUME).alias("tq"),
    )


def quotes_of_candles(candles: DataFrame) -> DataFrame:
    """Candles as quotes: the close as price, the count as size, just inside the bucket that the candle ends."""
    return candles.select("sym", (F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")).alias("ts"), F.col("side").alias("ttf"), F.col("c").alias("px"), F.col("cnt").cast(PRICE).alias("sz"), F.lit(0).cast("long").alias("seq"))


def quotes_of_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs as quotes of size zero."""
    zero = F.lit(0).cast(PRICE)
    sides = F.array(F.struct(F.lit(BID).alias("ttf"), F.col("bp").alias("px"), zero.alias("sz")), F.struct(F.lit(ASK).alias("ttf"), F.col("ap").alias("px"), zero.alias("sz")))
    return pairs.select("sym", "ts", F.inline(sides), "seq")


def resnap(rows: DataFrame, length: int, modulus: int = 0) -> DataFrame:
    """Snapshots of longer buckets from snapshots: the last quotes, and prices and volumes of trades carried into their sums."""
    end = bucket_end(F.col("ts"), length, modulus, closed_end=True)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    return rows.groupBy("sym", end.alias("end")).agg(last("bp").alias("bp"), last("bq").alias("bq"), last("ap").alias("ap"), last("aq").alias("aq"), vwap(F.col("tvpr"), F.col("tq")).alias("tvpr"), F.sum("tq").cast(VOLUME).alias("tq")).withColumnRenamed("end", "ts")


def merge_halves(rows: DataFrame) -> DataFrame:
    """Snapshots of one (sym, ts) of which one holds the bid and one the ask become one; zero counts as not there."""
    some = lambda c: F.max(F.when(F.col(c) != 0, F.col(c)))
    return rows.groupBy("sym", "ts").agg(*(some(c).alias(c) for c in ("bp", "bq", "ap", "aq", "tvpr", "tq")))


def carry_forward(rows: DataFrame) -> DataFrame:
    """Quotes missing in a bucket from the last bucket that has them."""
    before = Window.partitionBy("sym").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, True).over(before) for c in ("bp", "bq", "ap", "aq")})
