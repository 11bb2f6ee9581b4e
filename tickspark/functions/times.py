"""Time stamps: parsing, printing, zones, buckets and candle specs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,9}))?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def parse_iso(s: Column) -> Column:
    """``YYYY-MM-DD[THH:MM:SS[.fff]][zone]`` as UTC; a date alone is its last second."""
    part = lambda n: F.regexp_extract(s, ISO, n)
    zone = part(4)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(F.length(digits) == 4, F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(0)
    minutes = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    clock = F.when(part(2) == "", F.lit("23:59:59")).otherwise(part(2))
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0")
    local = F.try_to_timestamp(F.concat_ws(" ", part(1), F.concat_ws(".", clock, fraction)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    return F.when(part(1) != "", local - F.make_dt_interval(mins=minutes))


def is_date_only(s: Column) -> Column:
    return (F.regexp_extract(s, ISO, 1) != "") & (F.regexp_extract(s, ISO, 2) == "")


def parse_compact(s: Column) -> Column:
    """``YYYYMMDDHHMMSS``."""
    return F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def parse_as(s: Column, pattern: str) -> Column:
    """By a pattern of ``%Y %m %d %H %M %S`` and other characters, one or two digits each but for the year; null where it doesn't fit."""
    letters = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s"}
    out = ""
    for k, part in enumerate(pattern.split("%")):
        if k and part[:1] not in letters:
            raise ValueError(f"pattern {pattern!r}")
        rest = part[1:] if k else part
        out += (letters[part[0]] if k else "") + (f"'{rest}'" if re.search("[A-Za-z]", rest) else rest)
    return F.try_to_timestamp(s, F.lit(out)).cast("timestamp_ntz")


def is_leap_year(ts: Column) -> Column:
    year = F.year(ts)
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def day_of_year(ts: Column) -> Column:
    """1 to 366."""
    return F.dayofyear(ts)


def show_iso(ts: Column, sep: str = "T") -> Column:
    return F.concat(F.date_format(ts, f"yyyy-MM-dd'{sep}'HH:mm:ss.SSS"), F.lit("+00:00"))


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a stamp without zone."""
    return F.floor(micros(ts) / 1_000_000)


def micros(ts: Column) -> Column:
    """Microseconds since 1970; sessions run in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def to_utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def from_utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


#: UTC seconds at which TAI - UTC became 10, 11, ... 37 seconds.
LEAP_SECONDS = (
    63072000, 78796800, 94694400, 126230400, 157766400, 189302400, 220924800, 252460800, 283996800, 315532800,
    362793600, 394329600, 425865600, 489024000, 567993600, 631152000, 662688000, 709948800, 741484800, 773020800,
    820454400, 867715200, 915148800, 1136073600, 1230768000, 1341100800, 1435708800, 1483228800,
)
#: Fixed value: UTC second at which GPS time began.
GPS_START = 315_964_800


def tai_offset(sec: Column) -> Column:
    """TAI - UTC in seconds at a UTC second (9 before 1972)."""
    out = F.lit(9)
    for s in LEAP_SECONDS:
        out = out + (sec >= s).cast("int")
    return out


def gps_offset(sec: Column) -> Column:
    return tai_offset(sec) - 19


def to_tai(sec: Column) -> Column:
    """TAI second of a UTC second."""
    return sec + tai_offset(sec)


def from_tai(sec: Column) -> Column:
    """UTC second of a TAI second; an inserted second, 23:59:60, repeats the one before it (is_leap tells)."""
    out = sec - 9
    for k, s in enumerate(LEAP_SECONDS):
        before = 9 + k
        out = F.when(sec >= s + before, F.when(sec == s + before, F.lit(s - 1)).otherwise(sec - before - 1)).otherwise(out)
    return out


def is_leap(sec: Column) -> Column:
    """Whether a TAI second is an inserted one."""
    return F.coalesce(sec.isin([s + 9 + k for k, s in enumerate(LEAP_SECONDS)]), F.lit(False))


def to_gps(sec: Column) -> Column:
    """GPS second (since 1980-01-06) of a UTC second."""
    return to_tai(sec) - 19 - GPS_START


def from_gps(sec: Column) -> Column:
    return from_tai(sec + 19 + GPS_START)


def datenum(ts: Column) -> Column:
    """Days since year 0, 719529 at 1970-01-01."""
    return micros(ts).cast("double") / 86_400e6 + 719_529


def bucket_end(ts: Column, length: int, modulus: int = 0, closed_end: bool = False) -> Column:
    """End of the bucket of a stamp: [end - length, end) for points, (end - length, end] for spans."""
    us, size, offset = micros(ts) - (1 if closed_end else 0), length * 1_000_000, modulus * 1_000_000
    return F.timestamp_micros(us - F.pmod(us - offset, F.lit(size)) + size).cast("timestamp_ntz")


def candle_width(spec: Column) -> Column:
    """Seconds of a spec ``cNNu`` with u of s, m, h, d."""
    n = F.regexp_extract(spec, r"^c([0-9]+)([smhd])$", 1)
    unit = F.regexp_extract(spec, r"^c([0-9]+)([smhd])$", 2)
    per = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(n != "", n.try_cast("bigint") * per).try_cast("int")


def show_candle_width(sec: Column) -> Column:
    out = F.concat(F.lit("c"), sec.cast("string"), F.lit("s"))
    for per, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        out = F.when((sec > 0) & (sec % per == 0), F.concat(F.lit("c"), F.floor(sec / per).cast("string"), F.lit(unit))).otherwise(out)
    return out
