"""Order, top-k and set operations on ticks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "idx", "ttf", "seq")


def chronological(ticks: DataFrame) -> DataFrame:
    """Total order over everything: a range partitioning and a sort in each partition."""
    return ticks.orderBy(*ORDER)


def chronological_within(ticks: DataFrame, partitions: int) -> DataFrame:
    """Ranges of time, each sorted: what a write needs."""
    return ticks.repartitionByRange(partitions, "ts").sortWithinPartitions(*ORDER)


def top(ticks: DataFrame, n: int, by: str, *, per_symbol: bool = False) -> DataFrame:
    if not per_symbol:
        return ticks.orderBy(F.desc(by), *ORDER).limit(n)
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.desc(by), *ORDER))
    return ticks.withColumn("rank", rank).where(F.col("rank") <= n)


def union(*parts: DataFrame) -> DataFrame:
    """All ticks of several tables by column name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ticks of only one table, with ``side`` < or >, each as often as it is too many.  Columns match by name."""
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("<")).unionByName(b.exceptAll(a).withColumn("side", F.lit(">")))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(a.columns))


def distinct_union(*parts: DataFrame) -> DataFrame:
    return union(*parts).distinct()
