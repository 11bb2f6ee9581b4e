"""Matrices of doubles as MAT files of level 5.

A variable is column after column, so a row is spread over the file: its place in
each column depends on how many rows there are.  Rows are sorted and numbered
first, counts by task giving the first number of each; then tasks write their
runs of rows into every column at once.
"""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.sinks import candle_matrix, snapshot_matrix
from tickspark.work import shared_folder

# Fixed values of the format: element types, the class of doubles, version and byte order.
INT8, INT32, UINT32, DOUBLE, MATRIX = 1, 5, 6, 9, 14
DOUBLES, VERSION, ENDIAN = 6, 0x0100, b"IM"
FILE_HEADER, MOST_BYTES = 128, (1 << 32) - 1


def file_header() -> bytes:
    return b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", VERSION) + ENDIAN


def _padded(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // 8) * 8, b"\0")


def variable_header(name: str, rows: int, columns: int) -> bytes:
    """All of a variable before its numbers."""
    label = name.encode("ascii")
    inner = struct.pack("<IIII", UINT32, 8, DOUBLES, 0) + struct.pack("<IIii", INT32, 8, rows, columns) + struct.pack("<II", INT8, len(label)) + _padded(label)
    inner += struct.pack("<II", DOUBLE, 8 * rows * columns)
    return struct.pack("<II", MATRIX, len(inner) + 8 * rows * columns) + inner


def layout(rows: int, columns: int, name: str, most: int = MOST_BYTES) -> list[tuple[str, int, int, int]]:
    """(name, first row, rows, place of its numbers) of each variable: as many rows as its 32-bit size takes."""
    per = max(1, (most - 256) // (8 * columns))
    out, at = [], FILE_HEADER
    for k, first in enumerate(range(0, max(rows, 1), per)):
        n = min(per, rows - first)
        own = name if rows <= per else f"{name}{k + 1}"
        at += len(variable_header(own, n, columns))
        out.append((own, first, n, at))
        at += 8 * n * columns
    return out


def _writer(path: str, columns: int, parts: list[tuple[str, int, int, int]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        firsts = np.array([p[1] for p in parts])
        for batch in batches:
            place = batch.column(0).to_numpy()
            data = [batch.column(1 + c).to_numpy(zero_copy_only=False) for c in range(columns)]
            order = np.argsort(place, kind="stable")
            place = place[order]
            part = np.searchsorted(firsts, place, "right") - 1
            cuts = np.flatnonzero((np.diff(place) != 1) | (np.diff(part) != 0)) + 1
            fd = os.open(path, os.O_WRONLY)
            try:
                for run in np.split(np.arange(place.size), cuts):
                    if run.size:
                        _, first, n, at = parts[int(part[run[0]])]
                        for c in range(columns):
                            os.pwrite(fd, data[c][order[run]].astype("<f8").tobytes(), at + 8 * (c * n + int(place[run[0]]) - first))
            finally:
                os.close(fd)
            yield pa.RecordBatch.from_pydict({"n": [int(place.size)]})

    return run


def write_matrix(rows: DataFrame, path: str, by: tuple[str, ...], name: str = "ticks", most: int = MOST_BYTES) -> None:
    """The columns of rows as doubles, null as 0, in the order of the columns by; more rows than a variable takes go to name1, name2 and so on.

    The path is on a file system that all tasks can write to at any place; the
    file gets its name when it is whole.
    """
    spark = rows.sparkSession
    columns = rows.columns
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = ranged.select(F.monotonically_increasing_id().alias("_id"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    at = f"{shared_folder(spark, 'matrix')}/rows"
    numbered.write.parquet(at)
    numbered = spark.read.parquet(at)
    # The id is a task's number and, in the low 33 bits, the row's in it: a row a task comes here.
    counts = sorted((r["task"], r["count"]) for r in numbered.groupBy(F.shiftright("_id", 33).alias("task")).count().collect())
    total, starts = 0, []
    for task, n in counts:
        starts.append((task, total))
        total += n
    parts = layout(total, len(columns), name, most)
    hidden = f"{path}.whole-{uuid.uuid4().hex[:8]}"
    try:
        with open(hidden, "wb") as out:
            out.write(file_header())
            for own, _, n, place in parts:
                head = variable_header(own, n, len(columns))
                out.seek(place - len(head))
                out.write(head)
            out.truncate(parts[-1][3] + 8 * parts[-1][2] * len(columns))
        if total:
            first = spark.createDataFrame(starts, "_task long, _first long")
            placed = numbered.join(F.broadcast(first), F.shiftright("_id", 33) == F.col("_task"))
            placed = placed.select((F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("_place"), *columns)
            written = placed.mapInArrow(_writer(hidden, len(columns), parts), "n long").agg(F.sum("n")).first()[0]
            if written != total:
                raise OSError(f"{written} of {total} rows written")
        os.replace(hidden, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(hidden)


def _indexed(matrix: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Day and index first, as the layout has them."""
    values = [c for c in matrix.columns if c not in ("day", "sym")]
    return matrix.join(dictionary.select("sym", "idx"), "sym", "left").select("day", "idx", *values)


def write_candles(candles: DataFrame, dictionary: DataFrame, path: str, sides: tuple[int, ...] = (1, 2, 3)) -> None:
    """Day number, symbol index, then open, high, low and close of each side; a row for each stamp and symbol."""
    write_matrix(_indexed(candle_matrix(candles, sides), dictionary), path, ("day", "idx"), "candles")


def write_snapshots(snapshots: DataFrame, dictionary: DataFrame, path: str) -> None:
    """Day number, symbol index, bid, ask and their sizes."""
    write_matrix(_indexed(snapshot_matrix(snapshots), dictionary).select("day", "idx", "bp", "ap", "bq", "aq"), path, ("day", "idx"), "snapshots")
