"""Shape of a price series, the hold map, and a picture of it."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.times import micros
from tickspark.schema import ASK, BID, key


def shapes(ticks: DataFrame, side: int = BID) -> DataFrame:
    """Per symbol open, close, low, high of one side and the returns between them.

    shape is M if the low comes before the high, N if after, - if at one time.
    """
    rows = ticks.where((F.col("ttf") == side) & F.col("px").isNotNull())
    out = rows.groupBy("sym").agg(
        F.min_by("px", key()).alias("o"), F.max_by("px", key()).alias("c"), F.min("px").alias("lo"), F.max("px").alias("hi"),
        F.min_by("ts", F.struct("px", "ts", "seq")).alias("lo_ts"), F.min_by("ts", F.struct(-F.col("px"), F.col("ts"), F.col("seq"))).alias("hi_ts"),
    )
    ratio = lambda a, b: F.round(F.when(b.cast("double") != 0, a.cast("double") / b.cast("double")), 6)
    o, c, lo, hi = (F.col(x) for x in ("o", "c", "lo", "hi"))
    return out.select(
        "sym", "o", "c", "lo", "hi", F.when(F.col("lo_ts") < F.col("hi_ts"), "M").when(F.col("lo_ts") > F.col("hi_ts"), "N").otherwise("-").alias("shape"),
        ratio(c - o, o).alias("ret"), ratio(hi - lo, lo).alias("span"), ratio(c - o, c + o).alias("rel_ret"), ratio(hi - lo, hi + lo).alias("rel_span"),
    )


def sample(ticks: DataFrame, slots: int = 256, sides: tuple[int, int] = (BID, ASK)) -> DataFrame:
    """(sym, slot, bid, ask): the first quotes in each of equal slots between a symbol's first and last tick, gaps filled from before."""
    rows = ticks.where(F.col("ttf").isin(list(sides)) & F.col("px").isNotNull())
    ends = rows.groupBy("sym").agg(F.min(micros(F.col("ts"))).alias("t0"), F.max(micros(F.col("ts"))).alias("t1"))
    span = F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    slot = F.floor((micros(F.col("ts")) - F.col("t0")) * (slots - 1) / span).cast("int")
    first = lambda t: F.min_by(F.when(F.col("ttf") == t, F.col("px")), F.when(F.col("ttf") == t, key()))
    out = rows.join(ends, "sym").groupBy("sym", slot.alias("slot")).agg(first(sides[0]).alias("bid"), first(sides[1]).alias("ask"))
    before = Window.partitionBy("sym").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.last(c, True).over(before) for c in ("bid", "ask")}).where("bid is not null and ask is not null")


def hold_map(ticks: DataFrame, slots: int = 256) -> DataFrame:
    """(sym, enter, leave, long, short): returns of buying at one slot's ask and selling at a later one's bid, and the reverse.

    A symbol has slots rows at most, so its self-join is bounded by slots squared.
    """
    s = sample(ticks, slots)
    a = s.select("sym", F.col("slot").alias("enter"), F.col("bid").alias("bid_in"), F.col("ask").alias("ask_in"))
    b = s.select("sym", F.col("slot").alias("leave"), F.col("bid").alias("bid_out"), F.col("ask").alias("ask_out"))
    ret = lambda x, y: F.round(F.when(F.col(y).cast("double") != 0, F.col(x).cast("double") / F.col(y).cast("double") - 1), 6)
    return a.join(b, "sym").where("enter <= leave").select("sym", "enter", "leave", ret("bid_out", "ask_in").alias("long"), ret("bid_in", "ask_out").alias("short"))


def png(matrix: list[list[float | None]]) -> bytes:
    """A grey picture of a small matrix collected on the driver; None is black."""
    known = [x for row in matrix for x in row if x is not None]
    low, high = (min(known), max(known)) if known else (0.0, 1.0)
    scale = 254 / (high - low) if high > low else 0.0
    raw = b"".join(b"\0" + bytes(0 if x is None else 1 + int((x - low) * scale) for x in row) for row in matrix)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", len(matrix[0]) if matrix else 0, len(matrix), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
