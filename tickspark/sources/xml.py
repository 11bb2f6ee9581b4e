"""XML feeds, by Spark's XML reader with explicit schemas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.schema import tick_columns
from tickspark.sources.text import fixings

if TYPE_CHECKING:
    import pandas as pd

SIDES = {"BID": 0x11, "ASK": 0x12, "TRADES": 0x13}
NAMES = ["sym", "side", "bar", "stamp", "o", "h", "l", "c"]
#: Rows that a task holds at a time, besides a document.
FRAME = 10_000
UNITS = {"sec": 1, "secs": 1, "min": 60, "mins": 60, "hour": 3600, "hours": 3600, "day": 86400}


def bar_seconds(setting: str) -> int | None:
    """Seconds of a bar size such as ``5 mins``."""
    m = re.match(r"\s*(\d+)\s+(\w+)", setting or "")
    return int(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None


def history_rows(content: str) -> Iterator[dict]:
    """Rows of documents chained by form feeds; what isn't XML is left out."""
    for doc in content.split("\f"):
        if not doc.strip():
            continue
        try:
            root = ET.fromstring(doc.strip())
        except ET.ParseError:
            continue
        query = next(iter(root.iter("query")), None)
        contract = next(iter(root.iter("reqContract")), None)
        if query is None or contract is None:
            continue
        sym = " ".join(v for v in (contract.get(k) for k in ("symbol", "secType", "exchange", "expiry", "currency", "multiplier")) if v)
        for row in root.iter("row"):
            yield {"sym": sym, "side": query.get("whatToShow"), "bar": bar_seconds(query.get("barSizeSetting", "")), "stamp": row.get("date"), **{k: row.get(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))}}


def history_frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents, in frames of at most FRAME."""
    import pandas as pd

    rows = (row for part in parts for data in part["value"] for row in history_rows(bytes(data).decode("utf-8", "replace")))
    while frame := list(islice(rows, FRAME)):
        yield pd.DataFrame(frame, columns=NAMES)


def history(spark: SparkSession, path: str, zone: str = "Europe/Berlin") -> DataFrame:
    """Bars of a trading station's history files as candles without volume, stamped at their end; local stamps are in zone.

    A row of Spark's text source is a document, so no task holds a file, and large files are split.
    """
    docs = spark.read.option("lineSep", "\f").text(path).select(F.col("value").cast("binary").alias("value"))
    rows = docs.mapInPandas(history_frames, "sym string, side string, bar int, stamp string, o string, h string, l string, c string")
    local = F.coalesce(F.try_to_timestamp("stamp", F.lit("yyyyMMdd  HH:mm:ss")), F.try_to_timestamp("stamp", F.lit("yyyyMMdd HH:mm:ss")), F.try_to_timestamp("stamp", F.lit("yyyyMMdd"))).cast("timestamp_ntz")
    utc = F.when(F.col("stamp").rlike("^[0-9]{9,}$"), F.timestamp_seconds(F.col("stamp").try_cast("bigint")).cast("timestamp_ntz")).otherwise(F.convert_timezone(F.lit(zone), F.lit("UTC"), local))
    ttf = F.lit(None).cast("int")
    for name, code in SIDES.items():
        ttf = F.when(F.col("side") == name, code).otherwise(ttf)
    price = lambda c: F.col(c).try_cast("decimal(18,4)")
    out = rows.select(*tick_columns(sym=F.col("sym"), ts=utc + F.make_dt_interval(secs=F.col("bar")), msec=F.lit(0), ttf=ttf, o=price("o"), h=price("h"), l=price("l"), c=price("c"), sta_ts=utc, seq=F.monotonically_increasing_id()))
    return out.where("ts is not null and ttf is not null")


def reference_rates(spark: SparkSession, path: str) -> DataFrame:
    """Daily reference rates: nested ``Cube`` elements of day, and currency and rate."""
    schema = "Cube array<struct<_time: string, Cube: array<struct<_currency: string, _rate: decimal(18,4)>>>>"
    days = spark.read.format("xml").option("rowTag", "Cube").option("mode", "PERMISSIVE").schema(schema).load(path).select(F.inline("Cube"))
    flat = days.where(F.col("_time").isNotNull()).select(F.col("_time").cast("date").alias("day"), F.inline("Cube"))
    return fixings(flat.select("day", F.col("_currency").alias("currency"), F.col("_rate").alias("rate")).where("rate is not null"))


READERS: dict[str, Callable[..., DataFrame]] = {"ibhist": history, "gesmes": reference_rates}
