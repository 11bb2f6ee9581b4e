"""The binary container as a Spark data source: a page is a partition.

``register`` makes ``spark.read.format("tickcontainer")`` known.  Planning reads
headers and footers; tasks read the bytes of their page and, once per file, the
symbol table.  ``stream`` follows a growing file.  Both open files by themselves,
by any path that pyarrow's file systems take; ``container(..., whole_files=True)``
takes files from Spark's own reader instead, one a task, for stores that only
Spark reaches.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tickspark.functions.decimals import narrow_value, wide_value
from tickspark.schema import WIDE_CODE, flow_of, tick_columns
from tickspark.sources import cells
from tickspark.sources.text import WIDE

NAME = "tickcontainer"
RAW = "sec long, msec int, idx int, sym string, ttf int, a long, b long, c long, d long, e long, f long, w long, seq long, file string"


def _open(path: str):
    """(file system, path in it); plain paths are local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The file, or those of a folder that aren't hidden, in order of their names."""
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = [x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name[:1] not in "._"]
    return [posixpath.join(path, name) for name in sorted(found)]


def read_range(path: str, start: int, length: int) -> bytes:
    system, at = _open(path)
    with system.open_input_file(at) as f:
        return f.read_at(length, start)


def size_of(path: str) -> int:
    system, at = _open(path)
    return system.get_file_info(at).size


def header_of(path: str) -> tuple[cells.Header, int]:
    return cells.read_header(read_range(path, 0, cells.HEADER)), size_of(path)


def pages_of(path: str) -> list[tuple[int, int]]:
    """(offset, length) of each page: from the footer, or else by the span of pages, stepping over packed ones."""
    header, size = header_of(path)
    if header.footer:
        found = cells.footer_cells(read_range(path, cells.footer_at(header, size), header.footer), header.order)
        return [p[:2] for p in found if p[1]][: header.pages or None]
    end = cells.table_at(header, size) if header.table else size
    out, at = [], header.place
    while at < end:
        span = cells.packed_size(read_range(path, at, 10)) if header.flags & cells.PACKED else 0
        # A page that isn't packed reaches to the next multiple, unless packed ones moved it.
        span = span or (cells.PAGE - at if not out else cells.PAGE)
        out.append((at, min(span, end - at)))
        at += span
    return out


@lru_cache(maxsize=8)
def symbols_of(path: str, table: int, size: int) -> dict[int, str]:
    """Symbols by the index in the file; table and size tell versions of a growing one apart."""
    header, size = header_of(path)
    return cells.read_symbols(read_range(path, cells.table_at(header, size), header.table)) if header.table else {}


@dataclass
class Page(InputPartition):
    path: str
    offset: int
    length: int
    seq: int
    #: Bytes of the page that were read before.
    skip: int = 0

    def __post_init__(self):
        super().__init__((self.path, self.offset, self.skip))


def batch_of(ticks: dict[str, np.ndarray], names: dict[int, str], seq: int, path: str, base: int = 0):
    import pyarrow as pa

    index = ticks["idx"]
    if base:
        ticks = ticks | {"idx": np.where(index > 0, index + base, 0)}
    used = np.unique(index)
    lookup = np.array([names.get(int(i)) for i in used], object)
    sym = pa.array(lookup[np.searchsorted(used, index)] if used.size else [], pa.string())
    narrow = lambda c: pa.array(ticks[c].astype(np.int32))
    wide = lambda c: pa.array(ticks[c])
    number = pa.array(seq + np.arange(index.size, dtype=np.int64))
    columns = [wide("sec"), narrow("msec"), narrow("idx"), sym, narrow("ttf"), *(wide(c) for c in "abcdefw"), number, pa.array([path] * index.size, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RAW.split(", ")])


def read_page(page: Page) -> Iterator:
    header, size = header_of(page.path)
    data = read_range(page.path, page.offset + page.skip, page.length - page.skip)
    ticks = cells.decode_page(data if page.skip else cells.unpack_page(data), header.order, header.old)
    yield batch_of(ticks, symbols_of(page.path, header.table, size), page.seq + page.skip // cells.CELL, page.path, header.base)


def first_second(page: Page) -> int | None:
    """The second of the first tick of a page that isn't packed, else unknown."""
    header, _ = header_of(page.path)
    head = read_range(page.path, page.offset, cells.CELL)
    if cells.packed_size(head) or len(head) < cells.CELL:
        return None
    key = np.frombuffer(head[:8], f"{header.order}u8").astype(np.uint64)
    return int(cells.key_fields(key, header.old)[0][0]) if key[0] not in (0, cells.MARKER) else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        start, end = (self.options.get(k) for k in ("start", "end"))
        out, before = [], 0
        for path in files_of(self.options["path"]):
            pages = [Page(path, offset, length, before + (k << 18)) for k, (offset, length) in enumerate(pages_of(path))]
            before += len(pages) << 18
            if start is not None or end is not None:
                pages = self._between(pages, start, end)
            out += pages
        return out

    @staticmethod
    def _between(pages: list[Page], start: str | None, end: str | None) -> list[Page]:
        """Pages of an ordered file that can hold seconds of [start, end]: one ends before the next one's first second."""
        if not pages or not header_of(pages[0].path)[0].flags & cells.ORDERED:
            return pages
        first = [first_second(p) for p in pages]
        keep = []
        for k, page in enumerate(pages):
            late = end is not None and first[k] is not None and first[k] > int(end)
            after = first[k + 1] if k + 1 < len(pages) else None
            if not late and not (start is not None and after is not None and after < int(start)):
                keep.append(page)
        return keep

    def read(self, page: Page) -> Iterator:
        if page is not None:
            yield from read_page(page)


class _Follower(DataSourceStreamReader):
    """A growing file or folder.  An offset is how many bytes of pages of each file are complete."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path in files_of(self.options["path"]) if (end := complete(path)) > 0}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for n, path in enumerate(sorted(end)):
            done, until = start.get(path, 0), end[path]
            for k, (offset, length) in enumerate(pages_of(path)):
                stop = min(offset + length, until)
                if stop > max(offset, done):
                    out.append(Page(path, offset, stop - offset, (n << 40) + (k << 18), max(0, done - offset)))
        return out

    def read(self, page: Page) -> Iterator:
        yield from read_page(page)

    def commit(self, end: dict) -> None:
        pass


def complete(path: str) -> int:
    """End of the last tick that is there whole; a growing file has empty cells behind it, which aren't ticks yet."""
    pages = pages_of(path)
    if not pages:
        return 0
    header, _ = header_of(path)
    offset, length = pages[-1]
    data = read_range(path, offset, length)
    if cells.packed_size(data[:10]):
        return offset + length
    key = np.frombuffer(data[: len(data) // 16 * 16], f"{header.order}u8").reshape(-1, 2)[:, 0].astype(np.uint64)
    ttf = cells.key_fields(key, header.old)[3]
    free = (key == 0) | (key == cells.MARKER)
    step = np.where(free, 1, np.where(ttf & 32 != 0, 4, np.where(ttf & 16 != 0, 2, 1)))
    at = cells.starts(step)
    at = at[~free[at] & (at + step[at] <= key.size)]
    if at.size and step[at[-1]] > 1 and not any(data[(at[-1] + step[at[-1]] - 1) * cells.CELL :]):
        at = at[:-1]  # its last cell isn't written yet
    end = offset + int((at + step[at]).max(initial=0)) * cells.CELL
    # Nothing on this page yet: all before it is complete.
    return end if at.size else (pages[-2][0] + pages[-2][1] if len(pages) > 1 else 0)


class ContainerSource(DataSource):
    """Options: path (a file or folder), and start and end, in epoch seconds, to leave out pages of ordered files."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RAW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Follower(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool):
        from tickspark.sinks.container import PageWriter

        return PageWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def ticks_of(raw: DataFrame) -> DataFrame:
    """Tick columns of raw ones: numbers are exact, from mantissa and scale."""
    ttf = F.col("ttf")
    narrow = lambda cond, c: F.when(cond, narrow_value(F.col(c)))
    point, pair, snap, candle, volume = ttf.isin(1, 2, 3, 4, 5, 6, 7, 13, 14), ttf == 12, ttf == 0x1C, (ttf >= 0x11) & (ttf <= 0x16), ttf == 0x18
    ts = F.timestamp_micros(F.col("sec") * 1_000_000 + F.when(F.col("msec") < 1000, F.col("msec") * 1000).otherwise(0)).cast("timestamp_ntz")
    start: Column = F.when(F.col("e") < 100_000, ts - F.make_dt_interval(secs=F.col("e"))).otherwise(F.timestamp_seconds("e").cast("timestamp_ntz"))
    market = point & (F.col("a") == 0xE0000000)
    # Scale codes: of each narrow word its top bits; a volume candle's narrow numbers are its second and third.
    code = lambda c, at: F.shiftleft(F.shiftright(c, 30).bitwiseAND(F.lit(3)), 2 * at)
    codes = F.when(volume, code("c", 1) + code("d", 2) + F.shiftleft(F.shiftrightunsigned("w", 62), WIDE_CODE)).when(ttf.isin(*WIDE), F.shiftleft(F.shiftrightunsigned("w", 62), WIDE_CODE))
    codes = codes.when(snap, reduce(lambda x, y: x + y, (code(c, k) for k, c in enumerate("abcdef")))).when(candle, reduce(lambda x, y: x + y, (code(c, k) for k, c in enumerate("abcd")))).otherwise(code("a", 0) + code("b", 1))
    return raw.where("ttf < 48").select(
        *tick_columns(
            sym=F.col("sym"), idx=F.col("idx"), ts=ts, msec=F.col("msec"), flow=flow_of(F.col("msec")), ttf=ttf, px=narrow(point & ~market, "a"), sz=narrow(point, "b"), is_mkt=market, w=F.when(ttf.isin(*WIDE), wide_value(F.col("w"))),
            bp=narrow(pair | snap, "a"), ap=narrow(pair | snap, "b"), bq=narrow(snap, "c"), aq=narrow(snap, "d"), tvpr=narrow(snap, "e"), tq=narrow(snap, "f"),
            h=narrow(candle, "a"), l=narrow(candle, "b"), o=narrow(candle, "c"), c=narrow(candle, "d"), vwap=narrow(volume, "c"), twap=narrow(volume, "d"), sta_ts=F.when(candle | volume, start), cnt=F.when(candle | volume, F.col("f")), codes=codes, seq=F.col("seq"),
        )
    )


def _whole(parts: Iterator) -> Iterator:
    """Files as Spark read them to raw ticks."""
    for batch in parts:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            header, size, seq = cells.read_header(data[: cells.HEADER]), len(data), 0
            table = cells.table_at(header, size)
            names = cells.read_symbols(data[table : table + header.table]) if header.table else {}
            for offset, length in _pages_in(data, header):
                ticks = cells.decode_page(cells.unpack_page(data[offset : offset + length]), header.order, header.old)
                yield batch_of(ticks, names, seq, path, header.base)
                seq += 1 << 18


def _pages_in(data: bytes, header: cells.Header) -> Iterator[tuple[int, int]]:
    size = len(data)
    if header.footer:
        at = cells.footer_at(header, size)
        yield from [p[:2] for p in cells.footer_cells(data[at : at + header.footer], header.order) if p[1]][: header.pages or None]
        return
    end, at, first = cells.table_at(header, size) if header.table else size, header.place, True
    while at < end:
        span = (cells.packed_size(data[at : at + 10]) if header.flags & cells.PACKED else 0) or (cells.PAGE - at if first else cells.PAGE)
        yield at, min(span, end - at)
        at, first = at + span, False


def container(spark: SparkSession, path: str, dictionary: DataFrame | None = None, whole_files: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ticks of a container, or of a folder of them, with the symbols of their own tables or of a dictionary.

    A page is a task, whatever the size of its file; whole_files reads with
    Spark's reader, a file a task.  start and end (epoch seconds) leave out pages
    of ordered files that can't hold such ticks; rows are not filtered by them.
    """
    if whole_files:
        raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_whole, RAW)
    else:
        register(spark)
        options = {k: str(v) for k, v in (("start", start), ("end", end)) if v is not None}
        raw = spark.read.format(NAME).options(**options).load(path)
    out = ticks_of(raw)
    return out if dictionary is None else out.drop("sym").join(dictionary.select("idx", "sym"), "idx", "left").select(*out.columns)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of a growing container, or of a folder that gets new ones, as a stream: each tick once, whatever restarts."""
    register(spark)
    return ticks_of(spark.readStream.format(NAME).load(path))
