"""Candles, snapshots and keyed clean-up as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.adapters import events_to_ticks
from tickspark.functions.times import bucket_end
from tickspark.schema import ASK, BID, TRA, VOLUME, key


def read_ticks(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A growing folder of Parquet as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", glob).parquet(path) if glob else reader.parquet(path)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of ticks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return events_to_ticks(read_ticks(spark, sf_dir, schema, glob="events.parquet"))


def _timed(ticks: DataFrame, delay: str) -> DataFrame:
    """Watermarks take stamps with zone only; sessions run in UTC, so the cast moves nothing."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_candles(ticks: DataFrame, length: int = 300, modulus: int = 0, delay: str = "10 minutes") -> DataFrame:
    """As the batch candles.  In append mode a candle comes when the watermark passes its end; later ticks are dropped."""
    window = F.window("ts", f"{length} seconds", startTime=f"{modulus} seconds")
    rows = _timed(ticks.where(F.col("ttf").isin(BID, ASK, TRA) & F.col("px").isNotNull()), delay)
    out = rows.groupBy("sym", F.col("ttf").alias("side"), window.alias("w")).agg(F.min_by("px", key()).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", key()).alias("c"), F.count("*").alias("cnt"))
    return out.select("sym", "side", F.col("w.end").cast("timestamp_ntz").alias("ts"), F.col("w.start").cast("timestamp_ntz").alias("sta_ts"), "o", "h", "l", "c", "cnt")


def stream_snapshots(ticks: DataFrame, length: int = 300, modulus: int = 0, delay: str = "10 minutes") -> DataFrame:
    """As the batch snapshots."""
    from tickspark.functions.decimals import vwap

    window = F.window("ts", f"{length} seconds", startTime=f"{modulus} seconds")
    last = lambda c, t: F.max_by(F.when(F.col("ttf") == t, F.col(c)), F.when(F.col("ttf") == t, key()))
    trade = lambda c: F.when(F.col("ttf") == TRA, F.col(c))
    rows = _timed(ticks.where(F.col("ttf").isin(BID, ASK, TRA) & F.col("px").isNotNull()), delay)
    out = rows.groupBy("sym", window.alias("w")).agg(last("px", BID).alias("bp"), last("sz", BID).alias("bq"), last("px", ASK).alias("ap"), last("sz", ASK).alias("aq"), vwap(trade("px"), trade("sz")).alias("tvpr"), F.sum(trade("sz")).cast(VOLUME).alias("tq"))
    return out.select("sym", F.col("w.end").cast("timestamp_ntz").alias("ts"), "bp", "bq", "ap", "aq", "tvpr", "tq")


def stream_as_of(trades: DataFrame, quotes: DataFrame, lookback: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """(sym, ts, seq, px, sz, q_ts, q_px): each trade with the last quote of its symbol within lookback, null without one.

    Both sides are states that the watermark bounds.  A trade comes when no quote
    for it can come any more.
    """
    t = _timed(trades.select("sym", "ts", "seq", "px", "sz"), delay)
    q = _timed(quotes.select("ts", F.col("sym").alias("q_sym"), F.col("px").alias("q_px"), F.col("seq").alias("q_seq")), delay).withColumnRenamed("ts", "q_ts")
    near = (F.col("sym") == F.col("q_sym")) & (F.col("q_ts") <= F.col("ts")) & (F.col("q_ts") >= F.col("ts") - F.expr(f"INTERVAL {lookback}"))
    last = F.max(F.when(F.col("q_ts").isNotNull(), F.struct("q_ts", "q_seq", "q_px"))).alias("q")
    out = t.join(q, near, "leftOuter").groupBy("sym", "ts", "seq", "px", "sz").agg(last)
    plain = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select("sym", plain("ts").alias("ts"), "seq", "px", "sz", plain("q.q_ts").alias("q_ts"), "q.q_px")


def stream_sessions(ticks: DataFrame, gap: int, delay: str = "10 minutes") -> DataFrame:
    """As the batch sessions; one comes when the watermark passes its end."""
    rows = _timed(ticks.where(F.col("px").isNotNull()), delay)
    out = rows.groupBy("sym", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.min_by("px", key()).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", key()).alias("c"), F.count("*").alias("cnt"))
    return out.select("sym", F.col("w.start").cast("timestamp_ntz").alias("sta_ts"), F.col("w.end").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "cnt")


STATE = "ttf array<int>, px array<string>, sz array<string>"
CLEAN = "sym string, ttf int, ts timestamp, px decimal(18,4), sz decimal(18,4), seq long"


def _clean_step(_key, parts: Iterator, state) -> Iterator:
    """One symbol's new ticks: columns of all types at once, cut at halts."""
    from decimal import Decimal

    import pandas as pd

    rows = pd.concat(list(parts)).sort_values(["ts", "seq"], ignore_index=True)
    held = dict(zip(*state.get[:1], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
    halts = (rows["flow"] == "halt").fillna(False)
    rows["_part"] = halts.cumsum()
    rows = rows[~halts].reset_index(drop=True)
    group = [rows["_part"], rows["ttf"]]
    fresh = rows["_part"] == 0  # what is held counts up to the first halt
    known = fresh & rows["ttf"].isin(list(held))
    first = rows.groupby(group).cumcount() == 0
    same = ~first | known
    for k, c in enumerate(("px", "sz")):
        before = rows["ttf"].map({t: None if v[k] is None else Decimal(v[k]) for t, v in held.items()}).where(fresh, None).astype(object)
        value = rows[c].astype(object).where(rows[c].notna(), None)
        filled = value.groupby(group).ffill()
        filled = filled.where(filled.notna(), before)
        last = filled.groupby(group).shift(1).where(~first, before)
        same &= (filled == last) | (filled.isna() & last.isna())
        rows[c] = filled.where(filled.notna(), None)
    ends = rows[rows["_part"] == int(halts.sum())].groupby("ttf").last() if len(rows) else rows.set_index("ttf")
    kept = {} if halts.any() else held
    text = lambda v: None if pd.isna(v) else str(v)
    kept |= {int(t): (text(p), text(s)) for t, p, s in zip(ends.index, ends["px"], ends["sz"], strict=True)}
    state.update((list(kept), [v[0] for v in kept.values()], [v[1] for v in kept.values()]))
    yield rows.loc[~same, ["sym", "ttf", "ts", "px", "sz", "seq"]]


def stream_clean(ticks: DataFrame) -> DataFrame:
    """Per symbol and type: missing prices and sizes from the last tick, repeats dropped; the last ticks are the state.

    A halt of the symbol (flow ``halt``) forgets them and isn't given itself.
    """
    flow = F.col("flow") if "flow" in ticks.columns else F.lit(None).cast("string").alias("flow")
    rows = ticks.select("sym", "ttf", F.col("ts").cast("timestamp").alias("ts"), F.col("px").cast("decimal(18,4)").alias("px"), F.col("sz").cast("decimal(18,4)").alias("sz"), "seq", flow)
    return rows.groupBy("sym").applyInPandasWithState(_clean_step, CLEAN, STATE, "append", "NoTimeout")


def maintain(ticks: DataFrame, derive: Callable[[DataFrame], DataFrame], at: str, length: int, modulus: int = 0) -> None:
    """Keep what derive makes of buckets of a stream's ticks up to date, late ticks included, whatever their delay.

    A micro-batch is written below ``at/ticks``, in a folder of its number and in
    it by the day of the buckets' ends.  derive runs anew over all ticks of the
    days that the batch touches, and its rows replace those days below
    ``at/result``.  Both writes replace whole folders, so a batch that runs again
    changes nothing.
    """

    def day(ts) -> object:
        return F.date_format(ts, "yyyy-MM-dd")

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", day(bucket_end(F.col("ts"), length, modulus)))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{at}/ticks/batch={number:010d}")
        touched = [r["day"] for r in spark.read.parquet(f"{at}/ticks/batch={number:010d}").select("day").distinct().collect()] if not rows.isEmpty() else []
        if touched:
            every = spark.read.option("basePath", f"{at}/ticks").parquet(f"{at}/ticks").where(F.col("day").cast("string").isin([str(x) for x in touched]))
            out = derive(every.drop("batch", "day")).withColumn("day", day(F.col("ts")))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{at}/result")

    ticks.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def maintained(spark: SparkSession, at: str) -> DataFrame:
    """The result that maintain keeps."""
    return spark.read.parquet(f"{at}/result").drop("day")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over what is there now and return the result table, which the driver holds: for looking at small streams."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to a Parquet folder, each row once."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
