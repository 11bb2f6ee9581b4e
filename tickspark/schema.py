"""The tick table: one wide nullable row per tick, a union of kinds keyed by ``ttf``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)
#: Sums of sizes.
VOLUME = T.DecimalType(27, 4)
LOSSLESS = T.DecimalType(21, 8)
WIDE = T.DecimalType(31, 8)

# Tick types.
UNK, BID, ASK, TRA, FIX, STL, AUC, G32 = range(8)
VOL, VPR, VWAP, OI, PAIR, BID2, ASK2, G64 = range(8, 16)
CANDLE, QUAD = 0x10, 0x20
VOL_CANDLE, SNAPSHOT = 0x18, 0x1C
# Markers in the millisecond field; from 1000 on it is no time of day.
MIL24, PADDING, HALT, CONT, NEXIST = 1000, 1020, 1021, 1022, 1023
FLOWS = {MIL24: "mil24", PADDING: "padding", HALT: "halt", CONT: "cont", NEXIST: "nexist"}

#: Order of ticks; seq, the order of arrival, makes it total.
ORDER = ("ts", "msec", "idx", "ttf", "seq")

#: codes has the scale codes of a tick's numbers where they are known, two bits
#: each: of the n-th number of its type from bit 2 n on, of a wide one from bit 12 on.
WIDE_CODE = 12

TICKS = T.StructType(
    [
        T.StructField("sym", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("msec", T.IntegerType()),
        T.StructField("flow", T.StringType()),
        T.StructField("ttf", T.IntegerType()),
        T.StructField("px", LOSSLESS),
        T.StructField("sz", LOSSLESS),
        T.StructField("is_mkt", T.BooleanType()),
        T.StructField("w", WIDE),
        *(T.StructField(c, LOSSLESS) for c in ("bp", "ap", "bq", "aq", "tvpr", "tq", "o", "h", "l", "c", "vwap", "twap")),
        T.StructField("sta_ts", T.TimestampNTZType()),
        T.StructField("cnt", T.LongType()),
        T.StructField("vol", LOSSLESS),
        T.StructField("codes", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)


def tick_columns(**given: Column) -> list[Column]:
    """All tick columns, null where not given, in schema order and types."""
    unknown = set(given) - set(TICKS.names)
    if unknown:
        raise ValueError(f"no tick columns: {sorted(unknown)}")
    return [(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in TICKS]


def flow_of(msec: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in FLOWS.items():
        out = F.when(msec == value, F.lit(name)).otherwise(out)
    return out


def key(*more: Column | str) -> Column:
    """Arrival order within a series, for min_by and max_by."""
    return F.struct("ts", "seq", *more)
