"""Removal of long repeated byte strings.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  Prefix doubling would shuffle a row per byte in every round; this names
windows by samples of their hashes instead, in three steps that stay exact but
for chance collisions of 64-bit hashes:

1. Of each window of ``length`` bytes the smallest 64-byte hash is its name.
   Equal windows have equal names, and consecutive windows of one name form a run
   of some hundred starts, which is one row.  Spark counts the names; runs of a
   name that occurs once leave.
2. Runs of one name are compared by the hash of their whole stretch.  A stretch
   found twice is repeated in all its windows; from here on one run of each
   stretch stands for all.
3. Where one name still has different stretches, their windows are compared by
   the pair of the hashes of their halves.

Hashes aren't compared with bytes.  Hot strings are counted in each task before
anything is shuffled.  The rows that step 3 packs are sorted, so that a task that
runs again after a lost executor numbers its pieces as before.

The same steps find stretches of words that another document holds too: words
are numbers then, as bytes are, and windows count by documents, not by places.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.llm.common import Scratch, bucket_slices, mix64, pair64, read_table, sub_batches
from tickspark.llm.ngram_join import _BYTE, _power_tables, free_shuffles, word_hashes

GRAM, GRAM_WORDS = 64, 8
PIECE_BYTES = 1_000_000
#: The shortest stretch of words that the query reports: over 50.
PASSAGE_WORDS = 51


class _Text:
    """Several texts in one buffer, as bytes or words, and hashes of any stretch of it."""

    def __init__(self, texts: list[bytes], words: bool = False):
        if words:
            units, doc = word_hashes(texts)
            self.borders = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
        else:
            units = _BYTE[np.frombuffer(b"".join(texts), np.uint8)]
            self.borders = np.cumsum([0, *map(len, texts)])
        self.size = units.size
        up, self.down = _power_tables(self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(units * up[: self.size], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = self.size - size + 1
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])


def find_runs(texts: list[bytes], length: int, words: bool = False):
    """Runs of windows of one rank: (text, first start, last start, rank, hash of the stretch, whether the rank's gram is in it twice)."""
    t = _Text(texts, words)
    none = np.zeros(0, np.int64)
    if t.size < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    gram = min(GRAM_WORDS if words else GRAM, length)
    g = t.grams(gram)
    width = length - gram + 1
    low, have = g, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: g.size - width + 1], low[width - have :])
    n = low.size  # windows
    doc = np.searchsorted(t.borders, np.arange(n), "right") - 1
    valid = np.arange(n) + length <= t.borders[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    rank = low[first]
    stretch = t.hashes(first, last + length)
    # Does the gram of a run's rank occur twice in its stretch?  Only then can windows of one run be equal.
    values = np.unique(rank)
    table = np.zeros(1 << 18, bool)
    table[values & np.uint64((1 << 18) - 1)] = True
    at = np.flatnonzero(table[g & np.uint64((1 << 18) - 1)])
    where = np.minimum(np.searchsorted(values, g[at]), max(0, values.size - 1))
    hit = values[where] == g[at] if values.size else np.zeros(0, bool)
    codes = np.sort(where[hit] << 32 | at[hit])
    code = np.searchsorted(values, rank) << 32
    times = np.searchsorted(codes, code | (last + length - gram), "right") - np.searchsorted(codes, code | first, "left")
    d = doc[first]
    return d, first - t.borders[d], last - t.borders[d], rank, stretch, times > 1


def _encoded(batch) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]


def _runs(length: int, words: bool):
    def run(batches):
        import pyarrow as pa

        for batch in sub_batches(batches, PIECE_BYTES):
            d, first, last, rank, stretch, twice = find_runs(_encoded(batch), length, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(d)), pa.array(first), pa.array(last), pa.array(rank.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(twice)], ["key", "first", "last", "rank", "stretch", "twice"]
            )

    return run


_ROW = "bucket int, uid long, piece boolean, a binary, b binary"


def _windows(length: int, bits: int, words: bool):
    """Window ranks of the standing runs, packed by bucket, and one row for each piece with its runs.

    A rank that suffices for itself is marked: of bytes one that the piece has
    twice, of words one that two documents of the piece or a stretch of several have.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), ("piece", pa.bool_()), ("a", pa.binary()), ("b", pa.binary())])
        half = length // 2
        for k, batch in enumerate(sub_batches(batches, PIECE_BYTES)):
            uid = part << 32 | k
            t = _Text(_encoded(batch), words)
            key, first, last, alone = [], [], [], []
            for i, (dk, runs) in enumerate(zip(batch.column("key").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                for r in runs:
                    key.append(dk)
                    first.append(r["first"] + t.borders[i])
                    last.append(r["last"] + t.borders[i])
                    alone.append(r["alone"])
            first, last = np.array(first, np.int64), np.array(last, np.int64)
            n = last - first + 1
            no = np.repeat(np.arange(n.size), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[no]
            rank = pair64(t.hashes(at, at + half), t.hashes(at + half, at + length))
            order = np.argsort(rank, kind="stable")
            ranked, entry = rank[order], order
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if order.size else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            times = np.bincount(group, minlength=0)
            starts = np.flatnonzero(new)
            doc_start = t.borders[np.searchsorted(t.borders, first, "right") - 1] if first.size else first
            head = np.stack([np.array(key, np.int64), first - doc_start, np.array(alone, np.int64), n]).astype("<i8") if key else np.zeros((4, 0), "<i8")
            rows = [(uid % (1 << bits), uid, True, head.tobytes(), np.stack([group[np.argsort(order)]]).astype("<u4").tobytes())]
            distinct, many = ranked[starts], times > 1
            if words and order.size:
                docs, single = np.array(key, np.int64)[no[order]], np.array(alone, bool)[no[order]]
                many = (np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)) | ~np.logical_and.reduceat(single, starts)
            for b, s in bucket_slices(distinct >> np.uint64(64 - bits)):
                rows.append((b, uid, False, distinct[s].astype("<u8").tobytes(), many[s].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _count(table):
    """One bucket: whether each window rank that a piece sent is marked or sent by another piece too."""
    import pyarrow as pa

    rows = table.to_pylist()
    own = [r for r in rows if not r["piece"]]
    if own:
        values = [np.frombuffer(r["a"], "<u8") for r in own]
        _, inverse = np.unique(np.concatenate(values), return_inverse=True)
        many = np.concatenate([np.frombuffer(r["b"], bool) for r in own])
        again = (np.bincount(inverse, 1.0 + many)[inverse] >= 2).astype(np.uint8)
        at = 0
        for r, v in zip(own, values, strict=True):
            r["a"], r["b"] = again[at : at + v.size].tobytes(), None
            at += v.size
    return pa.Table.from_pylist(rows, schema=table.schema)


def _spans(length: int):
    def run(table):
        """One piece: the repeated stretches of the runs that stand for themselves only."""
        import pyarrow as pa

        rows = table.to_pylist()
        piece = next(r for r in rows if r["piece"])
        again = np.frombuffer(b"".join(r["a"] for r in sorted((r for r in rows if not r["piece"]), key=lambda r: r["bucket"])), bool)
        key, first, alone, n = np.frombuffer(piece["a"], "<i8").reshape(4, -1)
        hit = again[np.frombuffer(piece["b"], "<u4")] if again.size else np.zeros(0, bool)
        no = np.repeat(np.arange(n.size), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keep = hit & (alone[no] == 1)
        no, at = no[keep], at[keep]
        new = np.ones(no.size, bool)
        new[1:] = (no[1:] != no[:-1]) | (at[1:] != at[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], no.size)[: a.size] - 1
        return pa.table({"key": pa.array(key[no[a]]), "a": pa.array(first[no[a]] + at[a]), "b": pa.array(first[no[a]] + at[b] + length)})

    return run


def repeated_spans(docs: DataFrame, length: int, scratch: Scratch, words: bool = False) -> DataFrame:
    """(key, a, b): ranges, possibly overlapping, that a repeated string of length bytes covers.  docs: key, text.

    With words, ranges of words that a sequence of length words covers which a document of another key has too.
    """
    often = F.min("key") != F.max("key") if words else F.count("*") > 1
    runs = scratch.save(docs.mapInArrow(_runs(length, words), "key long, first long, last long, rank long, stretch long, twice boolean"), "runs")
    ranks = runs.groupBy("rank").agg(often.alias("often"), F.max("twice").alias("twice")).where("often" if words else "often or twice").select("rank")
    live = scratch.save(runs.join(ranks, "rank"), "live")
    stretches = live.groupBy("rank", "stretch").agg(often.alias("often"), F.max("twice").alias("twice"), F.min(F.struct("key", "first", "last")).alias("r"))
    ranks = stretches.groupBy("rank").agg((F.count("*") > 1).alias("several"), F.max("twice").alias("self"))
    stretches = scratch.save(stretches.join(ranks, "rank").select("rank", "stretch", "often", "r", (F.col("several") if words else F.col("several") | F.col("self")).alias("open")), "stretches")
    whole = live.join(stretches.where("often").select("rank", "stretch"), ["rank", "stretch"]).select("key", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    standing = stretches.where("open and often" if words else "open").select("r.key", "r.first", "r.last", (~F.col("often")).alias("alone"))
    if words:  # a stretch that one document alone has stands at each of its places
        own = stretches.where("open and not often").select("rank", "stretch")
        standing = standing.union(live.join(own, ["rank", "stretch"]).select("key", "first", "last", F.lit(True)))
    standing = standing.select("key", F.struct("first", "last", "alone").alias("run")).groupBy("key").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    total = runs.agg(F.sum(F.col("last") - F.col("first"))).first()[0] or 0
    bits = max(6, int(total // 4_000_000).bit_length())
    packed = docs.join(standing, "key").select("key", "text", "runs")
    if words:  # a document of several rows is one
        packed = packed.dropDuplicates(["key"])
    packed = packed.sortWithinPartitions("key").mapInArrow(_windows(length, bits, words), _ROW)
    counted = packed.groupBy("bucket").applyInArrow(_count, _ROW)
    part = scratch.save(counted.groupBy("uid").applyInArrow(_spans(length), "key long, a long, b long"), "spans")
    free_shuffles(docs.sparkSession)
    return whole.union(part)


def shared_words(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(key, n_shared_words) of documents with words in sequences of length words that a document of another key has too.  docs: key, text."""
    steps = Scratch(docs.sparkSession, "shared-words")
    spans = repeated_spans(docs, length, steps, words=True).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate("spans", none, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n")), lambda s: s["n"])
    out = scratch.save(spans.select("key", union.alias("n_shared_words")), "shared")
    steps.drop_all()
    free_shuffles(docs.sparkSession)
    return out


def _remove(schema):
    def run(batches):
        import pyarrow as pa

        for batch in sub_batches(batches, 4_000_000):
            n_bytes, n_removed, n_spans, sha, kept_text = [], [], [], [], []
            for data, spans in zip(_encoded(batch), batch.column("spans").to_pylist(), strict=True):
                at, kept, count = 0, [], 0
                end = -1
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if s[0] > end:
                        kept.append(data[max(at, 0) : s[0]])
                        count += 1
                        end = s[1]
                    else:
                        end = max(end, s[1])
                    at = end
                kept.append(data[at:])
                rest = b"".join(kept)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                n_spans.append(count)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept_text.append(rest)
            new = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            have = dict(zip(names, new, strict=True))
            yield pa.RecordBatch.from_arrays([have[c] if c in have else batch.column(c) for c in schema], schema)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, keep_bytes: bool = True, passage_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, n_shared_words and kept (binary) of every row.

    Null counts as empty; texts shorter than length lose nothing unless they
    contain nothing to lose; rows that agree in doc_id and text are occurrences
    of their own, so each takes the other's bytes.  Further columns are ignored.

    n_shared_words, with passage_words above 0: words in sequences of so many
    words, whatever their bytes, that another document has too.  It removes
    nothing; rows that agree in doc_id and text are one document there.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    shared = shared_words(keyed.select("key", "text"), passage_words, scratch) if passage_words else None
    spans = repeated_spans(keyed.select("key", "text"), length, scratch).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    rows = keyed.join(spans, "key", "left")
    if passage_words:
        kinds["n_shared_words"] = T.LongType()
        rows = rows.join(shared, "key", "left").withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0).cast("long")))
    if keep_bytes:
        kinds["kept"] = T.BinaryType()
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in kinds.items())])
    return rows.drop("key").mapInArrow(_remove(schema.names), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings of every row, and the hash of what is left.

    Null counts as empty.  Repeated rows are occurrences of their own and take
    each other's bytes.  Overlapping spans are one.  A text is handled in one
    task, with about 60 bytes of memory for each of the longest text.  An empty
    table gives an empty result.

    A passage of over 50 words can have fewer than 400 bytes and stays then;
    n_shared_words counts the words in such passages, of any size, that another
    document has too.
    """
    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_bytes=False, passage_words=PASSAGE_WORDS)


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE: dict[str, str] = {}
