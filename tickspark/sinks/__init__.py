"""Ticks as text, wide matrices and partitioned Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.decimals import mantissa, show
from tickspark.functions.text import int_to_hex
from tickspark.functions.times import datenum, seconds, show_candle_width, show_iso
from tickspark.schema import MIL24, ORDER, PAIR, SNAPSHOT, VOL_CANDLE, WIDE_CODE
from tickspark.sources.text import WIDE


def _show_stamp(ts: Column, msec: Column) -> Column:
    """A stamp without time of day prints as hour 24 of its day."""
    return F.when(msec == MIL24, F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T24:00:00.000+00:00"))).otherwise(show_iso(ts))


def _scale(value: Column) -> Column:
    """Scale code of a number of unknown one: as many decimals as 30 bits take, 8 only where it has 4 or more."""
    size = F.abs(value)
    return F.when((size < 5) & (value.cast("decimal(21,3)") != value), 0).when(size < 50_000, 1).when(size < 10_000_000, 2).otherwise(3)


def _plain_hex(n: Column) -> Column:
    return F.lower(F.hex(F.coalesce(n, F.lit(0)).cast("bigint")))


def tick_text(ticks: DataFrame) -> DataFrame:
    """(value): one tab-separated line a tick.

    Numbers have the decimals of their scale, from codes or else from their size;
    zero and nothing are ``0``.  Index and type are hexadecimal without padding.
    Candle starts are ``hex|iso``, or ``hex|cNNu`` for a width, counts ``hex|n``, trade price and
    quantity of a snapshot ``hex|number``.  Ticks of other types have no numbers.
    """
    if "codes" not in ticks.columns:
        ticks = ticks.withColumn("codes", F.lit(None).cast("bigint"))
    ttf = F.col("ttf")
    candle, snap, pair, volume = (ttf >= 0x11) & (ttf <= 0x16), ttf == SNAPSHOT, ttf == PAIR, ttf == VOL_CANDLE
    head = F.concat_ws("\t", F.coalesce("sym", F.lit("0")), _show_stamp(F.col("ts"), F.col("msec")), _plain_hex(F.col("idx")), _plain_hex(ttf))
    sta = seconds(F.col("sta_ts")).cast("bigint")
    start = F.concat_ws("|", int_to_hex(sta, 8), F.when(sta < 100_000, show_candle_width(sta)).otherwise(show_iso(F.col("sta_ts"))))
    count = F.coalesce("cnt", F.lit(0))
    # The numbers of a type, shown by one function over them.
    of = lambda *cs: F.array(*(F.coalesce(F.col(c), F.lit(0)).cast("decimal(21,8)") for c in cs))
    point = ttf.isin(1, 2, 3, 4, 5, 6, 7, 13, 14)
    numbers = F.when(candle, of("h", "l", "o", "c")).when(snap, of("bp", "ap", "bq", "aq", "tvpr", "tq")).when(pair, of("bp", "ap")).when(volume, of("vwap", "twap")).when(point, of("px", "sz")).otherwise(of())
    # Behind a wide number the codes of the narrow ones begin with the second.
    first = F.when(volume, 1).otherwise(0)
    coded = F.transform("numbers", lambda v, i: F.struct(v.alias("v"), F.coalesce(F.call_function("shiftright", F.col("codes"), (i + F.col("first")) * 2).bitwiseAND(F.lit(3)).cast("int"), F.when(v == 0, 0).otherwise(_scale(v))).alias("code")))

    def shown(x: Column, i: Column) -> Column:
        text = F.coalesce(show(x["v"], x["code"]), F.lit("0"))
        word = F.call_function("shiftleft", x["code"].cast("bigint"), F.lit(30)) + mantissa(x["v"], x["code"]).bitwiseAND(F.lit((1 << 30) - 1))
        return F.when(F.col("snap") & (i >= 4), F.concat_ws("|", int_to_hex(word, 8), text)).otherwise(text)

    rows = ticks.select(head.alias("head"), numbers.alias("numbers"), first.alias("first"), snap.alias("snap"), "codes", F.col("w"), ttf.alias("ttf"), start.alias("start"), count.alias("count"), (point & F.coalesce("is_mkt", F.lit(False))).alias("mkt"))
    rows = rows.withColumn("texts", F.transform(coded, shown))
    wide_code = F.coalesce(F.shiftright("codes", WIDE_CODE).bitwiseAND(F.lit(3)).cast("int"), F.lit(1))
    wide = F.coalesce(show(F.col("w"), wide_code), F.lit("0"))
    texts = F.when(F.col("mkt"), F.concat(F.array(F.lit("mkt")), F.slice("texts", 2, 1))).otherwise(F.col("texts"))
    texts = F.when(F.col("ttf").isin(*WIDE), F.concat(F.array(wide), texts)).otherwise(texts)
    spans = F.array(F.col("start"), F.concat_ws("|", int_to_hex(F.col("count"), 8), F.col("count").cast("string")))
    texts = F.when(((F.col("ttf") >= 0x11) & (F.col("ttf") <= 0x16)) | (F.col("ttf") == VOL_CANDLE), F.concat(texts, spans)).otherwise(texts)
    # A tick without numbers ends behind its type.
    return rows.select(F.concat(F.col("head"), F.lit("\t"), F.array_join(texts, "\t")).alias("value"))


def candle_matrix(candles: DataFrame, sides: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows of doubles (day number, sym, then o h l c of each side): one row per (ts, sym)."""
    cell = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c).cast("double"))).alias(f"{c}{s}")
    return candles.groupBy("ts", "sym").agg(*(cell(s, c) for s in sides for c in "ohlc")).select(datenum(F.col("ts")).alias("day"), "sym", *(f"{c}{s}" for s in sides for c in "ohlc"))


def snapshot_matrix(snapshots: DataFrame) -> DataFrame:
    """Rows of doubles (day number, sym, bid, ask, sizes, trade price and size)."""
    return snapshots.select(datenum(F.col("ts")).alias("day"), "sym", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("bp", "ap", "bq", "aq", "tvpr", "tq")))


def write_grouped(rows: DataFrame, path: str, mode: str = "errorifexists", kind: str = "side") -> None:
    """A folder for each symbol and in it one for each kind: the layout of a grouped array file.

    Tasks get ranges of (symbol, kind, stamp), so a symbol of any size is several files, one after the other in time.
    """
    rows.repartitionByRange("sym", kind, "ts").sortWithinPartitions("sym", kind, "ts").write.mode(mode).partitionBy("sym", kind).parquet(path)


def write_ticks(ticks: DataFrame, path: str, append: bool = False, codec: str = "zstd", by: tuple[str, ...] = ()) -> None:
    """Native storage: Parquet in chronological order; by, for instance ("sym",) or ("bucket",), splits it into folders."""
    order = [c for c in ORDER if c in ticks.columns]
    rows = ticks.repartitionByRange(*by, "ts")
    writer = rows.sortWithinPartitions(*by, *order).write.mode("append" if append else "overwrite").option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def with_interval(ticks: DataFrame, length: int) -> DataFrame:
    """Add bucket, the ISO stamp of the interval [k * length, (k + 1) * length) of each tick, to write by."""
    sec = seconds(F.col("ts"))
    return ticks.withColumn("bucket", F.date_format(F.timestamp_seconds(sec - F.pmod(sec, F.lit(length))), "yyyy-MM-dd'T'HH:mm:ss"))


def write_text(ticks: DataFrame, path: str, append: bool = False) -> None:
    order = [c for c in ORDER if c in ticks.columns]
    tick_text(ticks.orderBy(*order)).write.mode("append" if append else "overwrite").text(path)


PRINTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"ticktext": tick_text, "candle_matrix": candle_matrix, "snapshot_matrix": snapshot_matrix}


def register_sink(name: str, show: Callable[[DataFrame], DataFrame]) -> None:
    """Make a printer usable by name."""
    PRINTERS[name] = show
