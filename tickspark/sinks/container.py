"""Ticks to the binary container.

A folder of container files is what tasks write by themselves: each file has a
run of pages, its symbols and its footer.  An index has 16 bits in a file, so
larger ones go to files of their own by blocks of 65,535, less the block's base,
which stands in the header.  Files get a hidden name first and
their own at the commit; a job that fails leaves none.  ``write_single`` lays the
pages of such files into one: offsets by prefix sums over their footers, the
bytes copied by tasks, each page to its place.
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from tickspark.functions.decimals import narrow_word, wide_word
from tickspark.functions.times import seconds
from tickspark.schema import WIDE_CODE
from tickspark.sources import cells
from tickspark.sources import container as source

#: Pages of a file, which a task holds until it is full.
PAGES_PER_FILE = 16
WORDS = ("sec", "msec", "idx", "ttf", *"abcdefw")


def place_of() -> list[Column]:
    """Second, millisecond field, index, type and arrival of a tick: the order of a file."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # From 1000 on the field is a marker; else the stamp has the milliseconds.
    msec = F.when(F.col("msec") >= 1000, F.col("msec")).otherwise(F.floor(F.pmod(us, F.lit(1_000_000)) / 1000).cast("int"))
    return [F.floor(us / 1_000_000).cast("bigint").alias("sec"), msec.cast("int").alias("msec"), F.coalesce("idx", F.lit(0)).alias("idx"), F.col("ttf"), F.col("seq").cast("bigint").alias("seq")]


def raw_of(ticks: DataFrame) -> DataFrame:
    """Raw columns of ticks, as the source gives them: the numbers as words."""
    ttf = F.col("ttf")
    candle, volume, snap, pair = (ttf >= 0x11) & (ttf <= 0x16), ttf == 0x18, ttf == 0x1C, ttf == 12
    sec, msec, idx, kind, seq = place_of()
    start, count = seconds(F.col("sta_ts")).cast("bigint"), F.coalesce(F.col("cnt"), F.lit(0))
    none = F.lit(None).cast("decimal(21,8)")

    codes = F.col("codes") if "codes" in ticks.columns else F.lit(None).cast("bigint")

    def pick(place: int, **at) -> Column:
        """The word of the column that counts for the type, at its scale where that is known."""
        value = none
        for c, cond in at.items():
            value = F.when(cond, F.col(c).cast("decimal(21,8)")).otherwise(value)
        known = F.call_function("shiftright", codes, 2 * (F.lit(place) - F.when(volume, 1).otherwise(0))).bitwiseAND(F.lit(3)).cast("int")
        return narrow_word(value, known)

    point = ~(candle | volume | snap | pair)
    first = F.when(point & F.coalesce("is_mkt", F.lit(False)), F.lit(0xE0000000)).otherwise(pick(0, px=point, bp=snap | pair, h=candle))
    return ticks.select(
        sec, msec, idx, F.col("sym"), kind,
        first.alias("a"), pick(1, sz=point, ap=snap | pair, l=candle).alias("b"), pick(2, bq=snap, o=candle, vwap=volume).alias("c"), pick(3, aq=snap, c=candle, twap=volume).alias("d"),
        F.when(candle | volume, F.coalesce(start, F.lit(0))).otherwise(pick(4, tvpr=snap)).alias("e"), F.when(candle | volume, count).otherwise(pick(5, tq=snap)).alias("f"),
        wide_word(F.col("w"), F.shiftright(codes, WIDE_CODE).bitwiseAND(F.lit(3)).cast("int")).alias("w"), seq, F.lit("").alias("file"),
    )


@dataclass
class Files(WriterCommitMessage):
    #: Hidden and own names.
    names: list[tuple[str, str]]


class _File:
    """A container file that grows page by page in memory."""

    def __init__(self, order: str, packed: bool, base: int = 0):
        self.order, self.packed, self.base = order, packed, base
        self.pages: list[bytes] = []
        self.cells: list[int] = []
        self.names: dict[str, int] = {}
        self.owner: dict[int, str] = {}

    def name(self, idx: int, sym: str) -> None:
        if self.owner.setdefault(idx, sym) != sym or self.names.setdefault(sym, idx) != idx:
            raise cells.ContainerError(f"index {idx + self.base} and symbol {sym!r} have another partner too")

    def add(self, page: bytes) -> None:
        self.cells.append(len(page) // cells.CELL)
        self.pages.append(cells.pack_page(page, self.order) if self.packed else page)

    def parts(self) -> Iterator[bytes]:
        places = lay(list(zip(map(len, self.pages), self.cells, strict=True)), self.packed)
        head, tail = head_and_tail(self.order, self.packed, places, self.names, self.base)
        yield head
        for k, page in enumerate(self.pages):
            yield page + filling(places, k)
        yield tail


def lay(pages: list[tuple[int, int]], packed: bool) -> list[tuple[int, int, int]]:
    """(offset, length, cells) of pages in a file: plain ones at the multiples of their span, packed ones close together."""
    out, at = [], cells.HEADER
    for k, (length, n) in enumerate(pages):
        at = at if packed else (k * cells.PAGE or cells.HEADER)
        out.append((at, length, n))
        at += length
    return out


def filling(places: list[tuple[int, int, int]], k: int) -> bytes:
    """Marker cells from the end of a page to the next one."""
    at, length, _ = places[k]
    return b"\xff" * (places[k + 1][0] - at - length) if k + 1 < len(places) else b""


def head_and_tail(order: str, packed: bool, places: list[tuple[int, int, int]], names: dict[str, int], base: int = 0) -> list[bytes]:
    """The header, and what comes behind the pages."""
    table = cells.symbol_table(names) if names else b""
    footer = cells.pack_footer(places, order)
    flags = cells.ORDERED | (cells.PACKED if packed else 0)
    header = cells.Header(order, False, flags, cells.HEADER, len(table), len(names), len(places), len(footer), base)
    return [header.pack(), table.ljust(-(-len(table) // cells.CELL) * cells.CELL, b"\0") + footer]


def base_of(idx: np.ndarray) -> np.ndarray:
    """What the indices in a file lack: multiples of 65,535."""
    return np.maximum(idx.astype(np.int64) - 1, 0) // cells.MOST_SYMBOLS * cells.MOST_SYMBOLS


class PageWriter(DataSourceArrowWriter):
    """Options: path, order (little or big), packed, pages (of a file)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.order = ">" if options.get("order", "little") == "big" else "<"
        self.packed = options.get("packed", "false").lower() == "true"
        self.most = int(options.get("pages", PAGES_PER_FILE))
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> Files:
        from pyspark import TaskContext

        task, attempt, written = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], []
        system, at = source._open(self.path)
        system.create_dir(at)
        file, waiting, held = _File(self.order, self.packed), [], 0

        def flush() -> None:
            nonlocal file
            name = f"part-{task:06d}-{len(written):05d}-{self.job}.ticks"
            hidden = f"_{self.job}-{attempt}-{name}"
            with system.open_output_stream(posixpath.join(at, hidden)) as out:
                for part in file.parts():
                    out.write(part)
            written.append((hidden, name))
            file = _File(self.order, self.packed)

        def pages(every: bool) -> None:
            """Write what fills pages, or all of it."""
            nonlocal waiting, held
            ticks = {c: np.concatenate([w[c] for w in waiting]) for c in (*WORDS, "sym")} if waiting else None
            start = 0
            # Ticks come block by block, so a page ends where it is full or where the block does.
            base = base_of(ticks["idx"]) if held else None
            while held:
                until = int(np.searchsorted(base, base[start], "right"))
                ends = np.cumsum(np.where(ticks["ttf"][start:until] & 16, 2, 1))
                n = int(np.searchsorted(ends, cells.PAGE_CELLS, "right"))
                if not every and start + n == base.size:
                    break
                if file.base != base[start]:
                    if file.pages:
                        flush()
                    file.base = int(base[start])
                part = {c: v[start : start + n] for c, v in ticks.items()}
                part["idx"] = part["idx"] - file.base
                index, first, place = np.unique(part["idx"], return_index=True, return_inverse=True)
                sym = part["sym"][first]
                if (odd := (part["sym"] != sym[place]) & (part["idx"] != 0)).any():
                    raise cells.ContainerError(f"index {part['idx'][odd][0] + file.base} has several symbols")
                for idx, own in zip(index.tolist(), sym.tolist(), strict=True):
                    if idx and own is not None:
                        file.name(idx, own)
                file.add(cells.encode_page(part, self.order))
                start, held = start + n, held - int(ends[n - 1])
                if len(file.pages) >= self.most:
                    flush()
            waiting = [{c: v[start:] for c, v in ticks.items()}] if held else []

        try:
            for batch in iterator:
                one = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in WORDS} | {"sym": np.array(batch.column("sym").to_pylist(), object)}
                waiting.append(one)
                held += int(np.where(one["ttf"] & 16, 2, 1).sum())
                if held >= cells.PAGE_CELLS:
                    pages(False)
            pages(True)
            if file.pages:
                flush()
        except BaseException:
            for hidden, _ in written:
                system.delete_file(posixpath.join(at, hidden))
            raise
        return Files(written)

    def commit(self, messages: list) -> None:
        system, at = source._open(self.path)
        system.create_dir(at)
        before = source.files_of(self.path) if self.overwrite else []
        for message in messages:
            for hidden, name in message.names if message else ():
                system.move(posixpath.join(at, hidden), posixpath.join(at, name))
        for path in before:
            system.delete_file(source._open(path)[1])
        self._clear(system, at)

    def abort(self, messages: list) -> None:
        system, at = source._open(self.path)
        self._clear(system, at)

    def _clear(self, system, at: str) -> None:
        """Hidden files of this job: of attempts that failed or came second."""
        from pyarrow import fs

        for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}-"):
                system.delete_file(x.path)


def write_container(ticks: DataFrame, path: str, dictionary: DataFrame | None = None, append: bool = False, order: str = "little", packed: bool = False, pages: int = PAGES_PER_FILE) -> None:
    """Ticks as a folder of container files, in chronological order within each block of 65,535 indices.

    Symbols need their index in the tick or in a dictionary; an index without
    symbol is kept, a tick without either has index 0.  A file has one symbol an
    index.  Numbers that neither scale takes are rounded half up.
    """
    source.register(ticks.sparkSession)
    if dictionary is not None:
        ticks = ticks.drop("idx").join(dictionary.select("idx", "sym"), "sym", "left")
    block = lambda idx: F.floor((F.greatest(idx, F.lit(1)).cast("bigint") - 1) / cells.MOST_SYMBOLS)
    # Words cost more than the exchange of ticks, so they are made once, behind it.
    place = place_of()
    rows = raw_of(ticks.repartitionByRange(block(place[2]), *place)).sortWithinPartitions(block(F.col("idx")), "sec", "msec", "idx", "ttf", "seq")
    writer = rows.write.format(source.NAME).mode("append" if append else "overwrite").option("order", order).option("packed", str(packed).lower()).option("pages", pages)
    writer.save(path)


def _copied(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            with open(path, "r+b") as out:
                for x in rows:
                    data = source.read_range(x["file"], x["start"], x["length"]) + b"\xff" * x["filling"]
                    os.pwrite(out.fileno(), data, x["target"])
            yield pa.RecordBatch.from_pydict({"n": [len(rows)]})

    return run


def write_single(ticks: DataFrame, path: str, dictionary: DataFrame | None = None, order: str = "little", packed: bool = False) -> None:
    """Ticks as one container file, on a file system that all tasks can write to at any place.

    All indices must be of one block of 65,535.  The driver sees footers and symbol
    tables only; pages go from file to file in tasks.  The file gets its name when it
    is whole.
    """
    parts = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    hidden = f"{path}.whole-{uuid.uuid4().hex[:8]}"
    spark = ticks.sparkSession
    write_container(ticks, parts, dictionary, order=order, packed=packed)
    try:
        names: dict[str, int] = {}
        found, counts, bases = [], [], set()
        for file in source.files_of(parts):
            header, size = source.header_of(file)
            bases.add(header.base)
            if len(bases) > 1:
                raise cells.ContainerError(f"indices of several blocks of {cells.MOST_SYMBOLS}, which one file can't have")
            for start, length, n in cells.footer_cells(source.read_range(file, cells.footer_at(header, size), header.footer), header.order):
                found.append((file, start, length))
                counts.append(n)
            for idx, sym in source.symbols_of(file, header.table, size).items():
                if names.setdefault(sym, idx) != idx:
                    raise cells.ContainerError(f"symbol {sym!r} has several indices")
        if len(set(names.values())) < len(names):
            raise cells.ContainerError("an index has several symbols")
        mark = ">" if order == "big" else "<"
        places = lay([(length, n) for (_, _, length), n in zip(found, counts, strict=True)], packed)
        head, tail = head_and_tail(mark, packed, places, names, *bases)
        end = places[-1][0] + places[-1][1] if places else cells.HEADER
        with open(hidden, "wb") as out:
            out.truncate(end)
            out.write(head)
            out.seek(end)
            out.write(tail)
        rows = [(file, start, length, place[0], len(filling(places, k))) for k, ((file, start, length), place) in enumerate(zip(found, places, strict=True))]
        if rows:
            moves = spark.createDataFrame(rows, "file string, start long, length long, target long, filling long").repartition(min(len(rows), 1024))
            moves.mapInArrow(_copied(hidden), "n long").agg(F.sum("n")).collect()
        shutil.move(hidden, path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        with contextlib.suppress(FileNotFoundError):
            os.remove(hidden)
