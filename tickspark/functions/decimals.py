"""Fixed-point numbers: a mantissa and one of four decimal scales.

The narrow form has 30 bits of mantissa, the wide one 62; scale codes 0 to 3
stand for units of 1e-8, 1e-4, 1 and 1e4.  As Spark columns both are decimals;
what remains is which scale a text gets, and the printed form that follows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals printed and units, by scale code.
SCALE = {0: 8, 1: 4, 2: 0, 3: -4}
UNIT = {0: "0.00000001", 1: "0.0001", 2: "1", 3: "10000"}
NARROW_MOST, WIDE_MOST = (1 << 29) - 1, (1 << 61) - 1
NUMBER = r"^\s*[+-]?[0-9]*\.?[0-9]*"


def number_text(s: Column) -> Column:
    """The leading number of a text."""
    return F.trim(F.regexp_extract(s, NUMBER, 0))


def _parts(s: Column) -> tuple[Column, Column]:
    text = number_text(s)
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), "^0+(?=[0-9])", "")
    return whole, F.regexp_extract(text, r"\.([0-9]*)", 1)


def narrow_scale(s: Column) -> Column:
    """Scale code of a text in the narrow form: as many decimals as 30 bits take."""
    whole, fraction = _parts(s)
    n, lead = F.length(whole), F.substring(whole, 1, 1)
    fine = (F.length(fraction) >= 4) & (n == 1) & (lead < "5")
    return F.when(fine, 0).when((n < 5) | ((n == 5) & (lead < "5")), 1).when(n >= 8, 3).otherwise(2)


def wide_scale(s: Column) -> Column:
    """Scale code of a text in the wide form."""
    whole, fraction = _parts(s)
    return F.when((F.length(fraction) >= 4) & (F.length(whole) <= 10), 0).when(F.length(whole) <= 14, 1).when(F.length(whole) <= 18, 2).otherwise(3)


def _at(value: Column, code: Column) -> Column:
    """Rounded half up where the scale has decimals, else cut: digits beyond it aren't read."""
    out = F.round(value, 8).cast("decimal(38,8)")
    for c, unit in ((2, 1), (3, 10_000)):
        out = F.when(code == c, (value - value % unit).cast("decimal(38,8)")).otherwise(out)
    return F.when(code == 1, F.round(value, 4).cast("decimal(38,8)")).otherwise(out).try_cast("decimal(31,8)")


def _exact(s: Column) -> Column:
    """To the ninth decimal: the one behind the last that is kept decides how it is rounded."""
    return F.regexp_extract(number_text(s), r"^[+-]?[0-9]*(?:\.[0-9]{0,9})?", 0).try_cast("decimal(38,9)")


def parse_narrow(s: Column) -> Column:
    """Leading number of a text at its narrow scale."""
    return _at(_exact(s), narrow_scale(s)).try_cast("decimal(21,8)")


def parse_wide(s: Column) -> Column:
    return _at(_exact(s), wide_scale(s))


def parse_whole(s: Column) -> Column:
    """Only the integer part."""
    return F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def mantissa(value: Column, code: Column) -> Column:
    """Integer mantissa of a value at a scale."""
    unit = F.when(code == 0, F.lit(100_000_000)).when(code == 1, F.lit(10_000)).otherwise(F.lit(1))
    return F.when(code == 3, (value / 10_000).cast("bigint")).otherwise((value * unit).cast("bigint"))


def _of_parts(mant: Column, code: Column, digits: int) -> Column:
    out = F.lit(None).cast(f"decimal({digits},8)")
    for c, unit in UNIT.items():
        out = F.when(code == c, (mant.cast("decimal(19,0)") * F.lit(Decimal(unit))).cast(f"decimal({digits},8)")).otherwise(out)
    return out


def narrow_value(word: Column) -> Column:
    """The number of a 32-bit word (a bigint of its bits): mantissa in the low 30 bits, scale code above, exactly."""
    return _of_parts(F.shiftright(F.shiftleft(word.cast("bigint"), 34), 34), F.shiftright(word, 30).bitwiseAND(F.lit(3)), 21)


def wide_value(word: Column) -> Column:
    """The number of a 64-bit word."""
    return _of_parts(F.shiftright(F.shiftleft(word, 2), 2), F.shiftrightunsigned(word, 62), 31)


def _word(value: Column, bits: int, most: int, known: Column | None) -> Column:
    """At a known scale if it takes the number, else at the finest that does, 4 decimals before 8 where they are enough; half goes up."""
    fits = lambda c: F.abs(value) <= F.lit(Decimal(most) * Decimal(UNIT[c]))
    code = F.when(F.lit(False), 0) if known is None else F.when((known == 0) & fits(0) | (known == 1) & fits(1) | (known == 2) & fits(2) | (known == 3) & fits(3), known)
    code = code.when(fits(1) & (value == F.round(value, 4)), 1).when(fits(0), 0).when(fits(1), 1).when(fits(2), 2).when(fits(3), 3)
    mant = F.lit(None).cast("bigint")
    for c, unit in UNIT.items():
        mant = F.when(code == c, F.round(value / F.lit(Decimal(unit)), 0).cast("bigint")).otherwise(mant)
    word = F.shiftleft(code.cast("bigint"), bits).bitwiseOR(mant.bitwiseAND(F.lit((1 << bits) - 1)))
    return F.when(F.coalesce(value == 0, F.lit(True)), F.lit(0).cast("bigint")).when(code.isNull(), F.raise_error(F.concat(F.lit("number out of range: "), value.cast("string"))).cast("bigint")).otherwise(word)


def narrow_word(value: Column, known: Column | None = None) -> Column:
    """The 32 bits of a number as a bigint; null and zero are 0, beyond 5.36870911e12 is an error."""
    return _word(value.cast("decimal(21,8)"), 30, NARROW_MOST, known)


def wide_word(value: Column, known: Column | None = None) -> Column:
    """The 64 bits of a number as a bigint."""
    return _word(value.cast("decimal(31,8)"), 62, WIDE_MOST, known)


def show(value: Column, code: Column) -> Column:
    """Printed form: 8, 4 or no decimals by scale, ten thousands only at the largest; zero is ``0``."""
    out = value.cast("decimal(31,8)").cast("string")
    out = F.when(code == 1, value.cast("decimal(31,4)").cast("string")).otherwise(out)
    out = F.when(code == 2, (value - value % 1).cast("decimal(31,0)").cast("string")).otherwise(out)
    out = F.when(code == 3, (value - value % 10_000).cast("decimal(31,0)").cast("string")).otherwise(out)
    return F.when(value == 0, F.lit("0")).otherwise(out)


def narrow_parts(s: Column) -> Column:
    """Struct of v, the leading number of a text in the narrow form, and code, its scale; null without a digit."""
    return F.when(number_text(s).rlike("[0-9]"), F.struct(parse_narrow(s).alias("v"), narrow_scale(s).alias("code")))


def wide_parts(s: Column) -> Column:
    return F.when(number_text(s).rlike("[0-9]"), F.struct(parse_wide(s).alias("v"), wide_scale(s).alias("code")))


def truncated(value: Column, places: int) -> Column:
    """Towards zero, as a cast of a float."""
    unit = F.lit(10**places)
    scaled = value * unit
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("decimal(31,8)") / unit


def _limbs(x: Column, digits: int) -> tuple[Column, Column]:
    """A number of so many digits and 8 decimals as its integer and the rest."""
    x = x.cast(f"decimal({digits + 8},8)")
    whole = F.floor(x).cast(f"decimal({digits},0)")
    return whole, (x - whole).cast("decimal(9,8)")


def vwap(price: Column, size: Column) -> Column:
    """Aggregate: volume-weighted price truncated to 4 decimals, null without volume.

    Holds for the whole range of either number: products of integers and of
    fractions are summed apart, since no decimal takes all their digits, and the
    sums are divided one after the other, each with the remainder before it.
    So neither fractions nor the order of rows change the result.
    """
    given = price.isNotNull() & size.isNotNull()
    (p, pf), (s, sf) = _limbs(F.when(given, price), 13), _limbs(F.when(given, size), 19)
    units = F.sum((size.cast("decimal(27,8)") * 100_000_000).cast("decimal(27,0)")).cast("decimal(34,0)")
    sign = F.when(units < 0, -1).otherwise(1).cast("decimal(1,0)")
    by = F.abs(units)
    # In units of 1, 1e-8 and 1e-16.
    ones = (F.sum((p * s).cast("decimal(32,0)")) * sign).cast("decimal(38,0)")
    mixed = (F.sum((p * sf + pf * s).cast("decimal(28,8)")) * sign * 100_000_000).cast("decimal(38,0)")
    small = (F.sum((pf * sf).cast("decimal(17,16)")).cast("decimal(27,16)") * 10_000_000_000_000_000).cast("decimal(34,0)") * sign
    big = "decimal(38,0)"
    # Long division: each step divides what is pending, then shifts the remainder and takes in the next sum.
    shift = [(10_000, F.lit(0)), (10_000, mixed), (10_000, _floor_div(small, F.lit(10_000).cast("decimal(5,0)"))), (1, F.lit(0))]
    steps = F.array(*(F.struct(F.lit(by_).cast("decimal(5,0)").alias("shift"), more.cast(big).alias("more")) for by_, more in shift))

    def divide(done: Column, x: Column) -> Column:
        rest = F.pmod(done["pending"], by)
        quotient = (done["quotient"] + F.call_function("div", done["pending"] - rest, by)) * x["shift"].cast("bigint")
        return F.struct(quotient.alias("quotient"), (rest.cast("decimal(33,0)") * x["shift"] + x["more"]).cast(big).alias("pending"))

    out = F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("quotient"), ones.cast(big).alias("pending")), divide, lambda x: F.when((x["quotient"] < 0) & ((x["pending"] != 0) | (small % 10_000 != 0)), x["quotient"] + 1).otherwise(x["quotient"]))
    return F.when(by != 0, out.cast("decimal(22,0)") / F.lit(10_000)).cast("decimal(18,4)")


def _floor_div(a: Column, b: Column) -> Column:
    """Integer quotient, rounded down, of decimals without fraction; b is positive."""
    return (a - F.pmod(a, b)).cast("decimal(38,0)") / b


def feed_points(points: Column) -> Column:
    """Integer points of 1e-5, the last digit dropped where 30 bits don't hold it."""
    return F.when(points >= 536_870, F.floor(points / 10) * 10).otherwise(points).cast("decimal(18,0)") / F.lit(100_000)


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
