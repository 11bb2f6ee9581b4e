"""Feed formats as DataFrames of ticks, and a registry for more of them.

A text source is a function of a DataFrame with columns value (a line) and seq
(its place); ``read`` takes the lines from files.  Lines that don't parse are
dropped, or kept apart by ``bad_records``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.sources import binary, container, text, xml

TEXT: dict[str, Callable[..., DataFrame]] = {
    "ticktext": text.tick_text,
    "ariva": text.ariva,
    "truefx": text.truefx,
    "fxstreet": text.fxstreet,
    "forexfactory": text.forexfactory,
    "fieldlist": text.field_list,
    "rtdump": text.rt_dump,
}


def register_source(name: str, parse: Callable[..., DataFrame]) -> None:
    """Make a parser of lines readable by name."""
    TEXT[name] = parse


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, seq) of text files; seq grows with the place in a file and from file to file."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())


def read(spark: SparkSession, fmt: str, path: str, **options) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in TEXT:
        return TEXT[fmt](lines(spark, path), **options)
    if fmt in binary.READERS:
        return binary.READERS[fmt](spark, path, **options)
    if fmt in xml.READERS:
        return xml.READERS[fmt](spark, path, **options)
    if fmt == "container":
        return container.container(spark, path, **options)
    raise ValueError(f"no source {fmt!r}")


def bad_records(source: DataFrame, parsed: DataFrame) -> DataFrame:
    """Lines of which no tick was made."""
    return source.join(parsed.select("seq").distinct(), "seq", "left_anti")
