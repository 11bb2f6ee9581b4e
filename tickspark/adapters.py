"""Other tables as ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.schema import PRICE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_to_ticks(events: DataFrame) -> DataFrame:
    """The narrow tick columns of an event log: users are symbols, event types tick types."""
    ttf = F.lit(0)
    for code, name in enumerate(("view", "click", "purchase", "signup", "error"), 1):
        ttf = F.when(F.col("event_type") == name, code).otherwise(ttf)
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sym"),
        (F.col("user_id") + 1).cast("int").alias("idx"),
        F.col("ts"),
        ttf.alias("ttf"),
        F.col("value").cast(PRICE).alias("px"),
        F.get_json_object("props", "$.k").cast(PRICE).alias("sz"),
        F.col("event_id").alias("seq"),
    )


def lineitem_to_ticks(lineitem: DataFrame) -> DataFrame:
    """Trades of parts: unit price in whole cents and quantity at the ship date."""
    return lineitem.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sym"),
        (F.col("l_partkey") + 1).cast("int").alias("idx"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.lit(3).alias("ttf"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).cast(PRICE).alias("px"),
        F.col("l_quantity").cast(PRICE).alias("sz"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_ticks(table(spark, sf_dir, "events"))


def pairs(ticks_: DataFrame) -> DataFrame:
    """Bid-ask pairs made of ticks: the price, and a hundredth of the size above it."""
    return ticks_.select("sym", "idx", "ts", F.lit(12).alias("ttf"), F.col("px").alias("bp"), (F.col("px") + F.col("sz") / 100).cast(PRICE).alias("ap"), "seq")
