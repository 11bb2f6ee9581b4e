from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickspark.functions import decimals, text, times

NARROW = [
    ("1.32", 13200, 1, "1.3200"), ("1.32, 1.44", 13200, 1, "1.3200"), ("1.3102799999999999", 131028000, 0, "1.31028000"), ("9.3211", 93211, 1, "9.3211"),
    ("12.021", 120210, 1, "12.0210"), ("12.02101", 120210, 1, "12.0210"), ("12.02109999", 120211, 1, "12.0211"), ("93211", 93211, 2, "93211"), ("93211.01", 93211, 2, "93211"),
    ("43211", 432110000, 1, "43211.0000"), ("43211.01", 432110100, 1, "43211.0100"), ("9.321101", 93211, 1, "9.3211"), ("9.32117", 93212, 1, "9.3212"), ("4.32117", 432117000, 0, "4.32117000"),
]
WIDE = [("1.32", "1.3200"), ("1.3102799999999999", "1.31028000"), ("9.3211", "9.32110000"), ("12.021", "12.0210"), ("12.02101", "12.02101000"), ("12.021099999", "12.02110000"), ("-12.02109999", "-12.02109999")]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("s", "mantissa", "code", "shown"), NARROW)
def test_narrow(spark, s, mantissa, code, shown):
    v, c = decimals.parse_narrow(F.lit(s)), decimals.narrow_scale(F.lit(s))
    assert tuple(one(spark, decimals.mantissa(v, c), c, decimals.show(v, c))) == (mantissa, code, shown)


@pytest.mark.parametrize(("s", "shown"), WIDE)
def test_wide(spark, s, shown):
    assert one(spark, decimals.show(decimals.parse_wide(F.lit(s)), decimals.wide_scale(F.lit(s))))[0] == shown


def test_vwap_of_fractions(spark):
    rows = spark.sql("SELECT * FROM VALUES (1.5BD, 0.5BD), (2.5BD, 0.5BD) AS t(px, sz)")
    assert rows.agg(decimals.vwap(F.col("px"), F.col("sz"))).first()[0] == Decimal("2.0000")


def test_vwap_truncates(spark):
    rows = spark.createDataFrame([(Decimal("1.0000"), Decimal(1)), (Decimal("2.0000"), Decimal(2))], "px decimal(18,4), sz decimal(18,4)")
    assert rows.agg(decimals.vwap(F.col("px"), F.col("sz"))).first()[0] == Decimal("1.6666")
    assert rows.where("sz > 5").agg(decimals.vwap(F.col("px"), F.col("sz"))).first()[0] is None


@pytest.mark.parametrize(
    ("s", "want"),
    [("2011-03-01T10:00:02.766+00:00", "2011-03-01 10:00:02.766"), ("2011-03-01T10:00:02+02:00", "2011-03-01 08:00:02"), ("2011-03-01T10:00:02", "2011-03-01 10:00:02"), ("2011-03-01T10:00:02Z", "2011-03-01 10:00:02"), ("2011-03-01", "2011-03-01 23:59:59"), ("x", None), ("", None)],
)
def test_iso(spark, s, want):
    assert one(spark, times.parse_iso(F.lit(s)).cast("string"))[0] == want


def test_specs_and_buckets(spark):
    assert tuple(one(spark, times.candle_width(F.lit("c30m")), times.show_candle_width(F.lit(1800)), times.show_candle_width(F.lit(7)))) == (1800, "c30m", "c7s")
    at = F.lit("2024-01-01 00:05:00").cast("timestamp_ntz")
    assert tuple(str(x) for x in one(spark, times.bucket_end(at, 300), times.bucket_end(at, 300, closed_end=True))) == ("2024-01-01 00:10:00", "2024-01-01 00:05:00")
    assert one(spark, times.tai_offset(F.lit(1_700_000_000)))[0] == 37


def test_text(spark):
    line = F.lit("1.5 SYM@X b12.5 B7 kx")
    assert tuple(one(spark, text.hex_to_int(F.lit("1f|x")), text.hex_to_int(F.lit("?")), text.cell(line, "b"), text.cell(line, "B"), text.cell(line, "a"), text.leading_int(F.lit("12ab")))) == (31, None, "12.5", "7", None, 12)


def test_vwap_over_the_whole_range(spark):
    import decimal
    import random

    from tickspark.operators import snapshots

    rng, rows = random.Random(3), []
    for g in range(60):
        for _ in range(rng.choice([1, 2, 5, 40])):
            number = lambda low: Decimal(rng.choice([rng.randint(low, 10**8), rng.randint(0, 5 * 10**20), rng.randint(0, 10**12)])) / 10**8
            rows.append((f"g{g}", number(-(10**8) if g % 3 else 0), number(1)))
    rows += [("top", Decimal(5 * 10**12), Decimal(5 * 10**12))] * 500 + [("top", Decimal("0.00000001"), Decimal("4999999999999.99999999"))]
    rows += [("none", Decimal(1), Decimal(0)), ("null", None, None), ("below", Decimal("-1.00005"), Decimal(3))]
    df = spark.createDataFrame(rows, "sym string, px decimal(21,8), sz decimal(21,8)")
    want = {}
    with decimal.localcontext() as c:
        c.prec = 100
        for g in {r[0] for r in rows}:
            own = [(p, s) for n, p, s in rows if n == g and p is not None]
            size = sum((s for _, s in own), Decimal(0))
            want[g] = (sum(p * s for p, s in own) / size).quantize(Decimal("0.0001"), rounding=decimal.ROUND_DOWN) if size else None
    assert {r[0]: r[1] for r in df.groupBy("sym").agg(decimals.vwap(F.col("px"), F.col("sz")).alias("v")).collect()} == want
    ticks = df.where("sym = 'top'").withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "ttf": F.lit(3), "seq": F.lit(0)})
    assert snapshots.snapshots(ticks).first()["tvpr"] == want["top"]
