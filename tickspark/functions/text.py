"""Text helpers of the feed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_int(s: Column) -> Column:
    """Hexadecimal number of 15 digits at most up to a bar, null if there is none."""
    digits = F.regexp_extract(s, r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,15})(?![0-9A-Fa-f])", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("bigint"))


def int_to_hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def leading_int(s: Column) -> Column:
    digits = F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def cell(line: Column, letter: str) -> Column:
    """Value of a key-value cell such as ``b12.5`` in a blank-separated line."""
    value = F.regexp_extract(line, rf"(?:^|\s){letter}(-?[0-9][0-9.]*)", 1)
    return F.when(value != "", value)


def find(s: Column, part: str) -> Column:
    """0-based place of a part, -1 without it."""
    return F.instr(s, part) - 1


def json_value(s: Column, name: str) -> Column:
    return F.get_json_object(s, f"$.{name}")


def xml_attribute(s: Column, name: str) -> Column:
    value = F.regexp_extract(s, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(value != "", value)


def bit_set(values: Column) -> Column:
    """Aggregate: set of small numbers as a bit mask."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), values.cast("int")))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0
