"""What a file holds: tick types, candle widths, snapshot intervals, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.text import bit_set
from tickspark.functions.times import bucket_end, seconds
from tickspark.operators.filters import width

#: Widths in seconds that a guess is rounded up to.
WIDTHS = (1, 5, 10, 15, 30, 60, 300, 600, 900, 1800, 3600)


def type_sets(ticks: DataFrame) -> DataFrame:
    """Per symbol a bit mask of tick types and their number."""
    return ticks.groupBy("sym").agg(bit_set(F.col("ttf")).alias("types"), F.countDistinct("ttf").alias("n_types"))


def type_sets_by_interval(ticks: DataFrame, length: int, modulus: int = 0) -> DataFrame:
    """As type_sets in each bucket, labelled by the bucket that was observed."""
    end = bucket_end(F.col("ts"), length, modulus)
    out = ticks.groupBy("sym", end.alias("to_ts")).agg(bit_set(F.col("ttf")).alias("types"))
    return out.select("sym", (F.col("to_ts") - F.make_dt_interval(secs=F.lit(length))).alias("from_ts"), "to_ts", "types")


def candle_widths(candles: DataFrame) -> DataFrame:
    """Per (sym, side) the width in seconds, -1 if candles differ."""
    w = seconds(F.col("ts")) - seconds(F.col("sta_ts"))
    return candles.groupBy("sym", "side").agg(F.when(F.min(w) == F.max(w), F.min(w)).otherwise(-1).cast("long").alias("width"))


def rounded_width(gap: Column) -> Column:
    out = F.lit(86400)
    for w in reversed(WIDTHS):
        out = F.when(gap <= w, w).otherwise(out)
    return out.cast("long")


def guessed_widths(candles: DataFrame) -> DataFrame:
    """Per (sym, side) the least gap between candles, rounded up to a usual width; null for a single candle."""
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(Window.partitionBy("sym", "side").orderBy("ts")))
    least = candles.withColumn("gap", gap).groupBy("sym", "side").agg(F.min("gap").alias("gap"))
    return least.select("sym", "side", F.when(F.col("gap").isNotNull(), rounded_width(F.col("gap"))).alias("width"))


def snapshot_frequencies(snapshots: DataFrame) -> DataFrame:
    """Per symbol the least positive gap in seconds between snapshots."""
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(Window.partitionBy("sym").orderBy("ts")))
    return snapshots.withColumn("gap", gap).where("gap > 0").groupBy("sym").agg(F.min("gap").cast("long").alias("freq"))


def interval_label(sec: Column) -> Column:
    """``eod``, ``NNh``, ``NNm``, ``NNs`` or ``???``."""
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return (
        F.when(sec.isNull() | (sec <= 0), "???")
        .when(sec >= 86400, "eod")
        .when(sec % 3600 == 0, F.concat(two(sec / 3600), F.lit("h")))
        .when(sec % 60 == 0, F.concat(two(sec / 60), F.lit("m")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def counts(ticks: DataFrame) -> DataFrame:
    """Ticks, 16-byte cells, symbols and pages of 262144 cells."""
    out = ticks.agg(F.count("*").alias("n_ticks"), F.coalesce(F.sum(width(F.col("ttf"))), F.lit(0)).cast("long").alias("n_cells"), F.countDistinct("sym").alias("n_syms"))
    return out.withColumn("n_pages", F.ceil(F.col("n_cells") / 262_144).cast("long"))
