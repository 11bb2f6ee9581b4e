"""The quote that stands at each trade, and sessions of a symbol's ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.operators.clean import _by_day, _Slices
from tickspark.schema import key


def as_of(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """(sym, ts, seq, px, sz, q_ts, q_px, q_sz): each trade with the last quote of its symbol up to its stamp, null without one.

    Quotes of the trade's own stamp count, of several the one that came last.
    Either side is one row of a union in the order of a symbol's time, cut into
    slices; no pairs are made, so a symbol of any size is spread over tasks.
    """
    quote = F.struct(F.col("ts").alias("ts"), "px", "sz")
    row = lambda t, is_trade: t.select("sym", "ts", "seq", "px", "sz", F.lit(is_trade).alias("_trade"), (F.lit(None) if is_trade else quote).cast(t.select(quote.alias("q")).schema["q"].dataType).alias("_q"))
    s = _Slices(row(quotes, 0).unionByName(row(trades, 1)), ("sym",), {"q": F.col("_q")}, _by_day(), ("ts", "_trade", "seq"), skip_nulls=True)
    out = s.done(s.rows.withColumn("_last", s.latest("q"))).where("_trade = 1")
    return out.select("sym", "ts", "seq", "px", "sz", F.col("_last.ts").alias("q_ts"), F.col("_last.px").alias("q_px"), F.col("_last.sz").alias("q_sz"))


def sessions(ticks: DataFrame, gap: int) -> DataFrame:
    """(sym, sta_ts, ts, o, h, l, c, cnt) of runs of a symbol's ticks that no pause of more than gap seconds breaks; ts is gap after the last one."""
    rows = ticks.where(F.col("px").isNotNull()).withColumn("_at", F.col("ts").cast("timestamp"))
    out = rows.groupBy("sym", F.session_window("_at", f"{gap} seconds").alias("w")).agg(F.min_by("px", key()).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", key()).alias("c"), F.count("*").alias("cnt"))
    start, end = (x.cast("timestamp_ntz") for x in (F.col("w.start"), F.col("w.end")))
    return out.select("sym", start.alias("sta_ts"), end.alias("ts"), "o", "h", "l", "c", "cnt")


def sliding(ticks: DataFrame, length: int, step: int) -> DataFrame:
    """As candles of all sides together, of windows of length seconds that begin every step seconds."""
    rows = ticks.where(F.col("px").isNotNull()).withColumn("_at", F.col("ts").cast("timestamp"))
    out = rows.groupBy("sym", F.window("_at", f"{length} seconds", f"{step} seconds").alias("w")).agg(F.min_by("px", key()).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", key()).alias("c"), F.count("*").alias("cnt"))
    start, end = (x.cast("timestamp_ntz") for x in (F.col("w.start"), F.col("w.end")))
    return out.select("sym", start.alias("sta_ts"), end.alias("ts"), "o", "h", "l", "c", "cnt")
