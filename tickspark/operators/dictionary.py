"""Symbol dictionaries: (idx, sym), indices from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.work import shared_folder


def _numbered(symbols: DataFrame) -> DataFrame:
    """(n, sym), n from 1 in the order of symbols: ranges are numbered in their tasks, and the driver adds up a count a task."""
    at = f"{shared_folder(symbols.sparkSession, 'dictionary')}/symbols"
    ranged = symbols.select("sym").repartitionByRange("sym").sortWithinPartitions("sym")
    ranged.select(F.monotonically_increasing_id().alias("_id"), "sym").write.parquet(at)
    rows = symbols.sparkSession.read.parquet(at)
    task = F.shiftright("_id", 33)
    total, starts = 0, []
    for k, n in sorted((r["k"], r["count"]) for r in rows.groupBy(task.alias("k")).count().collect()):
        starts.append((k, total))
        total += n
    first = symbols.sparkSession.createDataFrame(starts, "_task long, _first long")
    place = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(first), task == F.col("_task")).select(place.cast("int").alias("n"), "sym")


def assign(ticks: DataFrame) -> DataFrame:
    """A fresh dictionary: distinct symbols, numbered in their order."""
    return _numbered(ticks.select("sym").where(F.col("sym").isNotNull()).distinct()).withColumnRenamed("n", "idx")


def lookup_symbol(ticks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """sym by idx, null for an index that isn't there."""
    return ticks.drop("sym").join(dictionary, "idx", "left")


def lookup_index(ticks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """idx by sym, null for a symbol that isn't there."""
    return ticks.drop("idx").join(dictionary, "sym", "left")


def extend(dictionary: DataFrame, ticks: DataFrame) -> DataFrame:
    """The dictionary with the symbols of ticks that it lacks, numbered on from its end."""
    new = ticks.select("sym").where(F.col("sym").isNotNull()).distinct().join(dictionary, "sym", "left_anti")
    top = dictionary.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("top"))
    numbered = _numbered(new).join(F.broadcast(top))
    return dictionary.select("idx", "sym").unionByName(numbered.select((F.col("top") + F.col("n")).alias("idx"), "sym"))


def remap(ticks: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Indices of one dictionary to those of another by way of the symbol."""
    move = source.select(F.col("idx").alias("_from"), "sym").join(target.select("sym", F.col("idx").alias("_to")), "sym").select("_from", "_to")
    return ticks.join(move, ticks["idx"] == move["_from"], "left").withColumn("idx", F.col("_to")).drop("_from", "_to")


def replace(dictionary: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Symbols renamed in place."""
    out = F.col("sym")
    for old, new in changes.items():
        out = F.when(F.col("sym") == old, F.lit(new)).otherwise(out)
    return dictionary.withColumn("sym", out)


def dump(dictionary: DataFrame) -> DataFrame:
    """Lines ``idx<TAB>sym``."""
    return dictionary.select(F.concat_ws("\t", F.col("idx").cast("string"), "sym").alias("value"))


def set_index(dictionary: DataFrame, sym: str, idx: int) -> DataFrame:
    """Force a symbol to an index; whoever had it leaves."""
    rest = dictionary.where((F.col("sym") != sym) & (F.col("idx") != idx))
    return rest.unionByName(dictionary.sparkSession.createDataFrame([(idx, sym)], "idx int, sym string"))
