"""Binary feeds: fixed records decoded with numpy, whole files as the unit of a task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.operators import clean
from tickspark.schema import tick_columns

if TYPE_CHECKING:
    import pandas as pd

# Record layouts, big-endian.
QUOTE = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("aq", ">f4"), ("bq", ">f4")])
OLD_QUOTE = np.dtype([("ms", ">u8"), ("ask", ">f8"), ("bid", ">f8"), ("aq", ">f8"), ("bq", ">f8")])
BAR = np.dtype([("s", ">u4"), ("o", ">u4"), ("c", ">u4"), ("l", ">u4"), ("h", ">u4"), ("v", ">f4")])
OLD_BAR = np.dtype([("ms", ">u8"), ("o", ">f8"), ("c", ">f8"), ("l", ">f8"), ("h", ">f8"), ("v", ">f8")])
HOUR_MS = 3_600_000
#: Bytes of files that are decoded in one go; a larger file is one by itself.
CHUNK = 4 << 20
PATH = re.compile(r"([A-Z]{6})/([0-9]{4})/([0-9]{2})/([0-9]{2})/([0-9]{2})h")


def guess(path: str) -> tuple[str | None, int]:
    """Symbol and epoch second of the hour from a path ``.../AAABBB/YYYY/mm/dd/HHh...`` (months from 00)."""
    m = PATH.search(path)
    if not m:
        return None, 0
    import calendar

    y, mo, d, h = (int(x) for x in m.groups()[1:])
    return m[1], calendar.timegm((y, mo + 1, d, h, 0, 0))


def _payload(data: bytes) -> bytes:
    """LZMA files are unpacked."""
    if data[:3] in (b"\x5d\x00\x00", b"\xfd7z"):
        import lzma

        return lzma.decompress(data)
    return data


def quote_rows(data: bytes, offset: int, multiplier: int = 1, magnifier: int = 100_000) -> np.ndarray:
    """(us, bid, ask, bid size, ask size) of quotes of either layout, which stamps more than an hour apart give away."""
    return quotes_of([_payload(data)], np.array([offset], np.float64), multiplier, magnifier)[0]


def quotes_of(files: list[bytes], offset: np.ndarray, multiplier: int = 1, magnifier: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The same of many unpacked files, and the place of the file that each quote is from; files of the old layout come last."""
    whole = [k for k, data in enumerate(files) if len(data) % QUOTE.itemsize == 0]
    new = np.frombuffer(b"".join(files[k] for k in whole), QUOTE)
    count = np.array([len(files[k]) // QUOTE.itemsize for k in whole], np.int64)
    first = (np.cumsum(count) - count)[count > 1]
    ms = new["ms"].astype(np.int64)
    gap = np.zeros(len(whole), np.int64)
    gap[count > 1] = ms[first + 1] - ms[first]
    fits = (gap >= 0) & (gap <= HOUR_MS)
    place, new = np.repeat(np.array(whole, np.int64), count), new if fits.all() else new[np.repeat(fits, count)]
    place = place if fits.all() else place[np.repeat(fits, count)]
    scale = multiplier / magnifier
    found = [[offset[place] * 1e6 + new["ms"] * 1e3, new["bid"] * scale, new["ask"] * scale, new["bq"] * 1e6, new["aq"] * 1e6]]
    places = [place]
    for k in sorted(set(range(len(files))) - {k for k, fit in zip(whole, fits.tolist(), strict=True) if fit}):
        old = np.frombuffer(files[k][: len(files[k]) // OLD_QUOTE.itemsize * OLD_QUOTE.itemsize], OLD_QUOTE)
        found.append([old["ms"] * 1e3, old["bid"], old["ask"], old["bq"] * 1e6, old["aq"] * 1e6])
        places.append(np.full(old.size, k))
    return np.concatenate([np.stack([np.asarray(c, np.float64) for c in cols]) for cols in found], axis=1), np.concatenate(places)


def bar_rows(data: bytes, offset: int, multiplier: int = 1, magnifier: int = 100_000) -> np.ndarray:
    """(us of the start, width in s, o, h, l, c, volume); the width is the gap of the first two bars, a day for a single one."""
    data = _payload(data)
    new = np.frombuffer(data, BAR) if len(data) % BAR.itemsize == 0 else None
    if new is not None and (new.size < 2 or 0 < int(new["s"][1]) - int(new["s"][0]) <= 86_400):
        sec, scale = offset + new["s"].astype(np.float64), multiplier / magnifier
        cols = [new[c] * scale for c in "ohlc"] + [new["v"] * 1e6]
    else:
        old = np.frombuffer(data[: len(data) // OLD_BAR.itemsize * OLD_BAR.itemsize], OLD_BAR)
        sec = old["ms"] / 1e3
        cols = [old[c] for c in "ohlc"] + [old["v"] * 1e6]
    width = np.full(sec.size, sec[1] - sec[0] if sec.size > 1 else 86_400.0)
    return np.stack([sec * 1e6, width, *(np.asarray(c, np.float64) for c in cols)])


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, content) of files, or of a table that has them already."""
    if isinstance(path, DataFrame):
        return path.select("path", "content")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def quote_frames(parts: Iterator[pd.DataFrame], name: str | None = None, refdate: int | None = None, multiplier: int = 1, magnifier: int = 100_000) -> Iterator[pd.DataFrame]:
    """Quotes of (path, content), a frame for the files that fill CHUNK."""
    import pandas as pd

    def rows_of(files: list[tuple[str, bytes]]) -> pd.DataFrame:
        known = [guess(p) for p, _ in files]
        offset = np.array([offset if refdate is None else refdate for _, offset in known], np.float64)
        (us, bid, ask, bq, aq), place = quotes_of([data for _, data in files], offset, multiplier, magnifier)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        number = np.arange(place.size) - np.repeat(first, np.diff(first, append=place.size))
        sym = np.array([name or sym for sym, _ in known], object)[place]
        return pd.DataFrame({"sym": sym, "us": us.astype(np.int64), "bid": bid.round(5), "ask": ask.round(5), "bq": bq.round(0), "aq": aq.round(0), "n": number})

    for part in parts:
        files, held = [], 0
        for p, data in zip(part["path"], part["content"], strict=True):
            files.append((p, _payload(data)))
            held += len(files[-1][1])
            if held >= CHUNK:
                yield rows_of(files)
                files, held = [], 0
        if files:
            yield rows_of(files)


def quotes(spark: SparkSession, path: str | DataFrame, name: str | None = None, refdate: int | None = None, every: bool = False, multiplier: int = 1, magnifier: int = 100_000) -> DataFrame:
    """Bid and ask ticks of quote files; repeats of a side are dropped unless every.

    name and refdate (epoch second) come from the path where they aren't given.
    """
    decode = partial(quote_frames, name=name, refdate=refdate, multiplier=multiplier, magnifier=magnifier)
    rows = _files(spark, path).mapInPandas(decode, "sym string, us long, bid double, ask double, bq double, aq double, n long")
    sides = F.array(F.struct(F.lit(1).alias("ttf"), F.col("bid").alias("px"), F.col("bq").alias("sz")), F.struct(F.lit(2).alias("ttf"), F.col("ask").alias("px"), F.col("aq").alias("sz")))
    rows = rows.select("sym", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.col("n").alias("seq"), F.inline(sides))
    rows = rows if every else clean.drop_repeats(rows)
    return rows.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=(F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000)) / 1000).cast("int"), ttf=F.col("ttf"), px=F.col("px"), sz=F.col("sz"), seq=F.col("seq")))


def bars(spark: SparkSession, path: str | DataFrame, flavour: str = "b", name: str | None = None, refdate: int | None = None, multiplier: int = 1, magnifier: int = 100_000) -> DataFrame:
    """Candles of bar files, of bids (flavour b) or asks (a), stamped at their end."""
    import pandas as pd

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                sym, offset = guess(p)
                us, width, o, h, l, c, v = bar_rows(data, offset if refdate is None else refdate, multiplier, magnifier)  # noqa: E741
                yield pd.DataFrame({"sym": name or sym, "us": us.astype(np.int64), "width": width.astype(np.int64), "o": o.round(5), "h": h.round(5), "l": l.round(5), "c": c.round(5), "v": v.round(0), "n": np.arange(us.size)})

    rows = _files(spark, path).mapInPandas(decode, "sym string, us long, width long, o double, h double, l double, c double, v double, n long")
    end = F.timestamp_micros(F.col("us") + F.col("width") * 1_000_000).cast("timestamp_ntz")
    return rows.select(*tick_columns(sym=F.col("sym"), ts=end, msec=F.lit(0), ttf=F.lit(0x11 if flavour == "b" else 0x12), o=F.col("o"), h=F.col("h"), l=F.col("l"), c=F.col("c"), sta_ts=F.timestamp_micros("us").cast("timestamp_ntz"), vol=F.col("v"), seq=F.col("n")))


def human_readable(ticks: DataFrame) -> DataFrame:
    """Lines ``sym<TAB>sec.ms<TAB>b|a<TAB>price<TAB>size`` of quotes."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    stamp = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad(F.floor(F.pmod(us, F.lit(1_000_000)) / 1000).cast("string"), 3, "0"))
    return ticks.select(F.concat_ws("\t", "sym", stamp, F.when(F.col("ttf") == 1, "b").otherwise("a"), F.col("px").cast("string"), F.col("sz").cast("string")).alias("value"))


READERS: dict[str, Callable[..., DataFrame]] = {"dukas": quotes, "dukas_bars": bars}
