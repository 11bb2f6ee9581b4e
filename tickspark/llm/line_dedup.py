"""Fuzzy line deduplication by MinHash.

A line is the set of its character shingles.  One hash per shingle, dealt to
SLOTS slots by its top bits, gives a signature of slot minima; an empty slot
borrows from a full one.  Lines that agree in a band of ROWS slots share
a bucket and are candidates: at the threshold similarity a pair is missed about
once in 250 times, more similar ones hardly ever.  Candidates are verified by
their exact Jaccard similarity, and of each connected component of verified links
one line stays: the one that comes first by document and line number.

Which bands are shared is found as in the n-gram join: a task packs the bands of
some megabytes of lines by hash range, a band held by many of these lines being one
entry, and hears which of them others hold too.  Equal lines are one node.  The
members of a bucket are compared with a centre, which joins families of copies at
one comparison a line.  Every pair of a bucket that still stands in two components
is then compared, in blocks of BLOCK members, so that no task gets more than two
blocks of one bucket, however large it is.  BLOCK decides how the work is cut,
never which pairs are compared.  Before the exact similarity the signatures are
compared, and only pairs that agree in less than PLAUSIBLE of all slots go.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.llm.common import Scratch, bucket_slices, identity, mix64, read_table, sub_batches
from tickspark.llm.components import components
from tickspark.llm.ngram_join import KEY_BITS, _pack, _rank, _unpack, free_shuffles

#: Shingles are of CHARS characters; _hashes is written for five.
CHARS, ROWS, BANDS = 5, 8, 30
SLOTS = ROWS * BANDS
WHITE = " \t\n\x0b\x0c\r"
PIECE_BYTES, PIECE_LINES = 4_000_000, 16_384
BUCKET_ENTRIES = 2_000_000
#: Members of a bucket that one task compares with each other, or with as many others.
BLOCK = 4096
#: Pairs whose lines are compared exactly at a time.
PAIRS = 256
#: Share of equal slots; of 8,000 pairs of similarity 0.80 to 0.83, of lines of 73 to 1,499 characters on average, the least share was 0.700.
PLAUSIBLE = 0.65

_NONE = np.iinfo(np.uint32).max
_STEP, _STEP_2 = np.uint32(0x9E3779B1), np.uint32(0x9E3779B1**2 % 2**32)
#: For each slot a random order of all others, from which it borrows while it is empty.
LENDERS = np.stack([np.random.default_rng(977 + s).permutation(SLOTS) for s in range(SLOTS)], 1)
_BAND = np.random.default_rng(4177).integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _hashes(code: np.ndarray) -> np.ndarray:
    """Mixed 32-bit hash of the shingle that starts at each character but the last CHARS - 1."""
    two = code[:-1] * _STEP
    two += code[1:]
    h = two[:-3] * _STEP_2
    h += two[2:-1]
    h *= _STEP
    h += code[CHARS - 1 :]
    t = h >> np.uint32(16)
    h ^= t
    for factor, shift in ((np.uint32(0x7FEB352D), np.uint32(15)), (np.uint32(0x846CA68B), np.uint32(16))):
        h *= factor
        np.right_shift(h, shift, out=t)
        h ^= t
    return h


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, SLOTS) slot minima of lines of at least CHARS characters."""
    sizes = np.array([len(x) for x in lines])
    h = _hashes(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32))
    # The top half of a hash decides the slot; shingles across two lines go to a place that is cut off.
    at = np.repeat(np.arange(len(lines)) * SLOTS, sizes)[: h.size]
    at += (h >> np.uint32(16)) * np.uint32(SLOTS) >> np.uint32(16)
    for k in range(1, CHARS):
        at[np.cumsum(sizes)[:-1] - k] = len(lines) * SLOTS
    out = np.full(len(lines) * SLOTS + 1, _NONE, np.uint32)
    np.minimum.at(out, at, h)
    out = out[:-1]
    # Each empty slot borrows from the first full one of a list of its own, so that the rows of a band stay independent.
    gap = np.flatnonzero(out == _NONE)
    slot = gap % SLOTS
    start, have = gap - slot, out.copy()
    for lender in LENDERS:
        if not gap.size:
            break
        lent = have.take(start + lender.take(slot))
        out[gap] = lent
        still = np.flatnonzero(lent == _NONE)
        gap, slot, start = gap.take(still), slot.take(still), start.take(still)
    return out.reshape(-1, SLOTS)


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """((lines, SLOTS) low bytes of the signatures, (lines, BANDS) hashes of KEY_BITS bits of the bands)."""
    low, out = np.zeros((len(lines), SLOTS), np.uint8), np.zeros((len(lines), BANDS), np.uint64)
    for a in range(0, len(lines), 512):
        sig = signatures(lines[a : a + 512])
        low[a : a + 512] = sig
        out[a : a + 512] = sig.reshape(-1, BANDS, ROWS).astype(np.uint64) @ _BAND
    out = mix64(out)
    out ^= np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0xC2B2AE3D27D4EB4F)
    return low, mix64(out) & np.uint64((1 << KEY_BITS) - 1)


_ROW = "bucket int, uid long, piece boolean, a binary, b binary, c binary"


def _deal(bits: int):
    """Bands of the distinct lines of each piece, packed by bucket, and one row for each piece that says which lines hold them.

    A piece is a stretch of consecutive rows of the written table and is named by
    the first.  A band held once carries 16 bits of its line's digest: lines that
    agree there are taken for equal ones, which costs one link in 65,536.
    """
    low_bits = np.uint64(KEY_BITS - bits)
    mask = np.uint64((1 << (KEY_BITS - bits)) - 1)

    def stretches(batches):
        for batch in sub_batches(batches, PIECE_BYTES, "line"):
            row = batch.column("row").to_numpy()
            cuts = np.union1d(np.flatnonzero(np.diff(row) != 1) + 1, np.arange(0, row.size, PIECE_LINES))
            for a, b in zip(cuts, np.append(cuts[1:], row.size), strict=True):
                yield batch.slice(a, b - a)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), ("piece", pa.bool_()), *((c, pa.binary()) for c in "abc")])
        for batch in stretches(batches):
            uid = batch.column("row")[0].as_py()
            lines = batch.column("line").to_pylist()
            no = np.array([i for i in {x: i for i, x in reversed(list(enumerate(lines)))}.values() if len(lines[i]) >= CHARS], np.uint16)
            if not no.size:
                continue
            key = sketches([lines[i] for i in no])[1].ravel()
            order = np.argsort(key)
            key, no = key[order], np.repeat(no, BANDS)[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.append(at, key.size)).astype(np.uint16)
            key = key[at]
            tag = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint16)[::8][no[at]]
            rows = [(int(mix64(np.array([uid], np.uint64))[0] & np.uint64((1 << bits) - 1)), uid, True, no.tobytes(), times.tobytes(), None)]
            for b, s in bucket_slices(key >> low_bits):
                rows.append((b, uid, False, _pack(key[s] & mask), np.minimum(times[s], 255).astype(np.uint8).tobytes(), tag[s].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _count(table):
    """One bucket: back to each piece go a byte for each of its bands, 0 if no other line holds it, and the bands that aren't 0."""
    import pyarrow as pa

    rows = table.to_pylist()
    own = [r for r in rows if not r["piece"]]
    if own:
        keys = [_unpack(r["a"]) for r in own]
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times, tag = (np.concatenate([np.frombuffer(r[c], kind) for r in own])[order] for c, kind in (("b", np.uint8), ("c", np.uint16)))
        several = (np.minimum.reduceat(tag, start) != np.maximum.reduceat(tag, start)) | (np.maximum.reduceat(times, start) > 1)
        total = np.empty(key.size, np.uint8)
        total[order] = np.repeat(np.where(several, _rank(np.add.reduceat(times, start, dtype=np.int64)), 0).astype(np.uint8), np.diff(np.append(start, key.size)))
        at = 0
        for r, k in zip(own, keys, strict=True):
            n = total[at : at + k.size]
            at += k.size
            r["a"], r["b"], r["c"] = _pack(k[n > 0]), n.tobytes(), None
    return pa.Table.from_pylist(rows, schema=table.schema)


def _found(bits: int):
    low_bits = np.uint64(KEY_BITS - bits)

    def run(table):
        """One piece: the shared bands of its lines, the line's weight, which grows with the number of holders of them all, and whether the row is the line's first."""
        import pyarrow as pa

        rows = table.to_pylist()
        piece = next(r for r in rows if r["piece"])
        own = sorted((r for r in rows if not r["piece"]), key=lambda r: r["bucket"])
        key = np.concatenate([np.uint64(r["bucket"]) << low_bits | _unpack(r["a"]) for r in own])
        size = np.frombuffer(b"".join(r["b"] for r in own), np.uint8)
        no, times = np.frombuffer(piece["a"], np.uint16), np.frombuffer(piece["b"], np.uint16)
        shared = size > 0
        held = times[shared]
        line = no[np.repeat(shared, times)].astype(np.int64)
        weight = np.bincount(line, np.repeat(size[shared], held)).astype(np.int64)[line]
        first = np.zeros(line.size, bool)
        first[np.unique(line, return_index=True)[1]] = True
        return pa.table({"key": pa.array(np.repeat(key, held).astype(np.int64)), "row": pa.array(piece["uid"] + line), "weight": pa.array(weight), "first": pa.array(first)})

    return run


def grams(line: str) -> set[str]:
    return {line[i : i + CHARS] for i in range(len(line) - CHARS + 1)} or {line}


def shingle_sets(lines: list[str]) -> list:
    """The distinct shingles of each line: sorted numbers of 12 bits a character where all lines together have characters few enough, else sets of strings."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    if code.size and code.max() >= 4096:
        seen = np.zeros(int(code.max()) + 1, bool)
        seen[code] = True
        code = (np.cumsum(seen, dtype=np.uint32) - np.uint32(1))[code]
    if not code.size or code.max() >= 4096 or min(map(len, lines)) < CHARS:
        return [grams(x) for x in lines]
    code = code.astype(np.uint64)
    packed = code[: code.size - CHARS + 1].copy()
    for k in range(1, CHARS):
        packed <<= np.uint64(12)
        packed |= code[k : code.size - CHARS + 1 + k]
    out, at = [], 0
    for x in lines:
        own = np.sort(packed[at : at + len(x) - CHARS + 1])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        at += len(x)
    return out


def similar(a, b, num: int, den: int) -> bool:
    """a, b: of shingle_sets, of one call."""
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if den * small < num * large:
        return False
    if isinstance(a, set):
        common = len(a & b)
    else:
        both = np.concatenate((a, b))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
    return (num + den) * common >= num * (small + large)


def _chunks(pairs: list, line_of):
    """(pairs, dict from each of their ends to its shingles) for runs of pairs; line_of(end) is the line."""
    for k in range(0, len(pairs), PAIRS):
        part = pairs[k : k + PAIRS]
        ends = list({x: None for p in part for x in p})
        yield part, dict(zip(ends, shingle_sets([line_of(x) for x in ends]), strict=True))


def _signed(batches):
    """The rows with the low byte of each slot of their line's signature, and 32 bits of each band."""
    import pyarrow as pa

    for batch in sub_batches(batches, 500_000, "line"):
        lines = batch.column("line").to_pylist()
        low, bands = sketches(lines)
        more = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (low, bands.astype("<u4"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "sig", "bands"])


def _slots(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _verify(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keep = (_slots(batch.column("sa")) == _slots(batch.column("sb"))).sum(1) >= PLAUSIBLE * SLOTS
            batch = batch.filter(pa.array(keep))
            pairs = list(zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), strict=True))
            linked = [similar(sets[x], sets[y], num, den) for part, sets in _chunks(pairs, str) for x, y in part]
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["u", "v"])

    return run


def _block_links(table, num: int, den: int) -> list[tuple[int, int]]:
    """Links between components, of lines within groups (key, i, j) that lie together; what already stands in one isn't compared.

    Rows are compared with those d places further on, for growing d, as long as
    both are of one group; of two blocks only rows of different blocks meet.  A
    pair of several buckets is compared in that of its first band.
    """
    key, i, j, block, comp = (table.column(c).to_numpy() for c in ("key", "i", "j", "block", "comp"))
    group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
    sig, line = _slots(table.column("sig")), table.column("line")
    bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), "<u4").reshape(-1, BANDS)
    band = (bands == key.astype(np.uint64).astype(np.uint32)[:, None]).argmax(1)
    first, second, at, d = [], [], np.arange(key.size), 0
    while True:
        d += 1
        at = at[: np.searchsorted(at, key.size - d)]
        at = at[group[at] == group[at + d]]
        if not at.size:
            break
        x = at[(comp[at] != comp[at + d]) & ((i[at] == j[at]) | (block[at] != block[at + d]))]
        x = x[(bands[x] == bands[x + d]).argmax(1) == band[x]]
        x = x[(sig[x] == sig[x + d]).sum(1) >= PLAUSIBLE * SLOTS]
        first.append(x)
        second.append(x + d)
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    pairs = np.stack([np.concatenate(x) if x else at for x in (first, second)], 1)
    for k in range(0, len(pairs), PAIRS):
        open_ = [(x, y) for x, y in pairs[k : k + PAIRS].tolist() if find(int(comp[x])) != find(int(comp[y]))]
        for part, sets in _chunks(open_, lambda x: line[x].as_py()):
            for x, y in part:
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a != b and similar(sets[x], sets[y], num, den):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(comp[x]), int(comp[y])))
    return out


def _blocks(num: int, den: int):
    """Of rows in the order of (key, i, j) the links in each such group; the last group of a batch waits for the next."""

    def run(batches):
        import pyarrow as pa

        def links(parts):
            out = _block_links(pa.Table.from_batches(parts).combine_chunks(), num, den)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

        rest = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            tail = batch.num_rows - int((ids != ids[-1]).any(1)[::-1].argmax()) if (ids != ids[-1]).any() else 0
            if tail or (rest and any(rest[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in ("key", "i", "j"))):
                if rest or tail:
                    yield links([*rest, batch.slice(0, tail)])
                rest = []
            rest.append(batch.slice(tail))
        if rest:
            yield links(rest)

    return run


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (of the row), no, line (trimmed), for every line with anything but white space."""
    # The identity is that of the row: taken before the lines are dealt out, so that each text is hashed and split once; outer, as then no filter repeats the split, and no text is without a line.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", *identity(), F.split("text", "\n").alias("lines"))
    rows = rows.select("doc_id", "k1", "k2", F.posexplode_outer("lines").alias("no", "line"))
    # Trimming a set of characters walks over the whole line, so only lines that need it are trimmed.
    ends = reduce(or_, (f(F.col("line"), F.lit(c)) for c in WHITE for f in (F.startswith, F.endswith)))
    return rows.withColumn("line", F.when(ends, F.btrim("line", F.lit(WHITE))).otherwise(F.col("line"))).where("line <> ''")


def shared_bands(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, row, weight, first): the bands that a line shares with other ones, for the first of equal lines of a piece."""
    bits = max(7, int(lines.count() * BANDS // BUCKET_ENTRIES).bit_length())
    packed = lines.select("row", "digest", "line").mapInArrow(_deal(bits), _ROW)
    return scratch.save(packed.groupBy("bucket").applyInArrow(_count, _ROW).groupBy("uid").applyInArrow(_found(bits), "key long, row long, weight long, first boolean"), "found")


def line_links(lines: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """lines: row, digest, line.  ((node, digest) of lines with a candidate, (node, component) of those with a link)."""
    spark = lines.sparkSession
    found = shared_bands(lines, scratch)
    free_shuffles(spark)
    # Equal lines of several pieces are one node; as they have the same bands, its own row stands for all.
    same = lines.select("row", "digest").join(found.where("first").select("row").hint("shuffle_hash"), "row")
    nodes = scratch.save(same.withColumn("node", F.min("row").over(_by("digest"))), "nodes")
    own = nodes.where("row = node").select("node")
    buckets = scratch.save(found.select("key", F.col("row").alias("node"), "weight").join(own.hint("shuffle_hash"), "node"), "buckets")
    text = lines.select(F.col("row").alias("node"), "line").join(own.hint("shuffle_hash"), "node").select("node", "line")
    text = scratch.save(text.mapInArrow(_signed, "node long, line string, sig binary, bands binary"), "text")
    free_shuffles(spark)
    # The original of a family meets most others: it makes the best centre.  Of equal weights all buckets prefer the same line, which spares pairs.
    weight = F.col("weight") * (1 << 40) + F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    centre = buckets.groupBy("key").agg(F.max_by("node", weight).alias("b"))
    pairs = buckets.join(centre, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    side = lambda x: text.select(F.col("node").alias(x), F.col("line").alias(f"l{x}"), F.col("sig").alias(f"s{x}"))
    edges = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb", "sa", "sb")
    edges = scratch.save(edges.mapInArrow(_verify(num, den), "u long, v long"), "links")
    labels = scratch.save(components(edges, scratch), "labels")
    free_shuffles(spark)
    # Buckets of two components or more.
    rows = scratch.save(buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "rows")
    apart = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    rows = rows.join(apart.select("key", F.ceil(F.col("size") / BLOCK).alias("n")), "key").withColumn("block", F.pmod(F.xxhash64("node"), "n"))
    rows = rows.select("key", "node", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
    rows = rows.join(text.select("node", "line", "sig", "bands"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    # The further links join components, and only those that they name are labelled anew.
    more = components(scratch.save(rows.mapInArrow(_blocks(num, den), "u long, v long"), "links"), scratch)
    more = scratch.save(more, "joined")
    known = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("under")), "component", "left").select("node", F.coalesce("under", "component").alias("component"))
    labels = scratch.save(known.union(more.join(labels, "node", "left_anti")), "labels")
    return nodes.where("row = node").select("node", "digest"), labels


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def repeated_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(k1, k2, no): the lines that go, because a line that came first is in their component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    lines = split_lines(docs).select("*", F.unhex(F.md5("line")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    lines = scratch.save(lines, "lines")
    nodes, labels = line_links(lines.select("row", "digest", "line"), scratch, num, den)
    linked = nodes.join(labels, "node").select("digest", "component")
    # Lines that are neither equal nor linked to others leave before the order of lines is looked at.
    several = lines.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    marked = several.join(linked.hint("shuffle_hash"), "digest", "full").select("digest", "component")
    group = F.coalesce(F.col("component").cast("string").cast("binary"), "digest").alias("family")
    copies = lines.select("digest", "doc_id", "no", "k1", "k2").join(marked.hint("shuffle_hash"), "digest").select(group, "doc_id", "no", "k1", "k2")
    copies = scratch.save(copies, "copies")
    kept = copies.groupBy("family").agg(F.min(F.struct("doc_id", "no", "k1", "k2")).alias("kept"))
    kept = scratch.save(kept.select("family", F.col("kept.no").alias("s_no"), F.col("kept.k1").alias("s_k1"), F.col("kept.k2").alias("s_k2")), "kept")
    free_shuffles(spark)
    return copies.join(kept.hint("shuffle_hash"), "family").where("no <> s_no or k1 <> s_k1 or k2 <> s_k2").select("k1", "k2", "no")


def _drop(names):
    def run(batches):
        import pyarrow as pa

        for batch in sub_batches(batches, 4_000_000):
            n_lines, n_removed, sha, kept = [], [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                drop = set(gone or ())
                left = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                n_lines.append(len(lines) if text else 0)
                n_removed.append(len(drop))
                sha.append(hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
                kept.append(left if text is not None else None)
            have = {"n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha), "kept": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([have[c] if c in have else batch.column(c) for c in names], names)

    return run


def drop_repeated_lines(docs: DataFrame, keep_text: bool = True, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and, if asked for, kept (the text without the lines that go) of every row.

    Null and empty texts have no lines.  Blank lines are no lines of text and
    stay; lines shorter than a shingle match equal lines only; white space
    around a line doesn't count.  Rows that agree in doc_id and text are treated
    alike, as one document.  Of equal doc_ids the lower line number comes first,
    then the row's hash decides; a null doc_id comes before all others.  A text
    is handled in one task, with about 20 bytes of its Python worker for each of
    the longest text; further columns are ignored.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), num, den).groupBy("k1", "k2").agg(F.collect_set("no").alias("gone"))
    names = ["doc_id", "n_lines", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=False))])
    keyed = docs.select("doc_id", "text", *identity()).join(gone.hint("shuffle_hash"), ["k1", "k2"], "left")
    return keyed.select("doc_id", "text", "gone").mapInArrow(_drop(names), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and the hash of what stays."""
    return drop_repeated_lines(read_table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE: dict[str, str] = {}
