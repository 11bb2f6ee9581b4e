"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of anything but blank, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is configured and there are no other machines (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tickspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    Reading a written table cuts the lineage, so a lost executor costs a re-read
    and never a recomputation of everything before it.  The tables go when the
    driver ends, as results may read them until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, tag: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.option("compression", "zstd").parquet(path)
        if self.n == 1:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(df._scratch_path)

    def drop_all(self) -> None:
        """Delete every table, when nothing reads any of them any more."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def identity(*cols: str) -> tuple[Column, Column]:
    """Columns k1 and k2, 128 bits by which rows that agree in cols (doc_id and text) are one."""
    cols = cols or ("doc_id", "text")
    return F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(1), *cols).alias("k2")


def n_words(col: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh uint64 array."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def pair64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b), order counts."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def bucket_slices(buckets: np.ndarray):
    """(bucket, slice) of each run of a sorted array: the cost is that of the array, however many buckets there are."""
    ends = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1 if buckets.size else buckets
    start = 0
    for end in ends.tolist():
        yield int(buckets[start]), slice(start, end)
        start = end


def sub_batches(batches, max_bytes: int = 4_000_000, column: str = "text"):
    """Arrow batches cut into slices of about max_bytes of text, one row at least and 65,535 at most."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + 65_535, int(np.searchsorted(ends, before + max_bytes, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
