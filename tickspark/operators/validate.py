"""Checks of a tick table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.operators.clean import with_previous_stamp
from tickspark.schema import CANDLE, QUAD


def issues(ticks: DataFrame) -> DataFrame:
    """(seq, sym, issue): missing stamps or symbols, types that aren't written, disorder in arrival."""
    rows = with_previous_stamp(ticks, "_prev")
    both = F.lit(CANDLE | QUAD)
    checks = {
        "no stamp": F.col("ts").isNull(),
        "no symbol": F.col("sym").isNull(),
        "bad type": F.col("ttf").isNull() | (F.col("ttf") < 0) | (F.col("ttf") > 63) | (F.col("ttf").bitwiseAND(both) == both),
        "unsorted": F.col("ts") < F.col("_prev"),
        "negative size": F.col("sz") < 0,
    }
    found = F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])
    return rows.select("seq", "sym", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))
