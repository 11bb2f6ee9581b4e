"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document is its set of distinct 5-word shingles (64-bit hashes, 56 bits kept).
Two documents whose Jaccard similarity reaches the threshold share a shingle
among the rarest few of each, so only those prefixes are joined.

Counting how many documents hold each shingle would shuffle a row per shingle.
Instead each task packs the shingles of a few megabytes of text into one binary
per hash bucket, with shingles that several of these documents hold counted
beforehand; a bucket's task counts and sends back only shingles of two documents
or more.  A shingle held by a third of all documents is one entry for each such
piece, whichever bucket it falls into.  Documents whose prefix consists of
shingles of their own can't have a partner and leave here; documents with equal
sets become one class.

Posting lists are not expanded to pairs.  The first waves compare members with
one centre of their list and merge what is similar; the last wave is exact: it
compares whatever still stands in different components and shares a prefix
shingle, after length and positional filters, each pair once, whatever number of
shingles it meets in.  Components are
then those of the full link graph: a pair that was never compared was already
connected.

Before each wave members leave a list in which they can't fit: a member's place
in its set and its size bound how large a partner may be, and no member may be
that small.  So texts of one template that are no links leave at once.  What is
left of a list is compared by classes of size, and classes in blocks, so that no
task gets all pairs of a list.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch, bucket_slices, mix64, pair64, read_table, sub_batches
from tickspark.llm.components import components

KEY_BITS = 56
PIECE_BYTES = 1_500_000
#: Members of a list in one block of the last wave; sizes of one class differ by less than this ratio.
BLOCK, CLASS = 256, 1.05
BUCKET_BYTES = 16_000_000

_RNG = np.random.default_rng(1234567)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_K = np.uint64(0x9E3779B97F4A7C15)
_K_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True


def _powers(k: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have, step = 1, k
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
        step = step * step
    return out


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "k" not in _CACHE or _CACHE["k"].size < n:
        with np.errstate(over="ignore"):
            size = 1 << max(16, int(n - 1).bit_length())
            _CACHE["k"], _CACHE["i"] = _powers(_K, size), _powers(_K_INV, size)
    return _CACHE["k"][:n], _CACHE["i"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) for all texts; words are runs of bytes that aren't ASCII white space."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _power_tables(raw.size + 1)
    sep = _SEP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sep, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: raw.size], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    # Sums modulo 2^64 are alike for some long words of two letters: long words get a hash of their own.
    for i in np.flatnonzero(ends - starts > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    borders = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(borders, starts, "right")


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (56 bits) of each text, A-Z lower-cased; a text of fewer words is one shingle, one without words none."""
    h, doc = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])
    full = np.zeros(0, np.uint64)
    if h.size >= words:
        size, full = 1, h
        run = h
        # doubling, then single words, up to the wanted length
        while size * 2 <= words:
            run = pair64(run[:-size], run[size:])
            size *= 2
        while size < words:
            run = pair64(run[: h.size - size], h[size:])
            size += 1
        full = run & np.uint64((1 << KEY_BITS) - 1)
    out = []
    for i in range(len(texts)):
        if n[i] >= words:
            out.append(np.unique(full[first[i] : first[i + 1] - words + 1]))
        elif n[i]:
            run = mix64(np.array([n[i]], np.uint64))
            for x in h[first[i] : first[i + 1]]:
                run = pair64(run, np.array([x]))
            out.append(run & np.uint64((1 << KEY_BITS) - 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _pack(low: np.ndarray) -> bytes:
    """48-bit numbers, 6 bytes each."""
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_ROW = "bucket int, uid long, piece boolean, a binary, b binary, c binary, d binary"


def _split(bits: int, shingler):
    """Texts to packed shingles by bucket, and one row for each piece that says which documents hold its shared shingles."""
    low_bits = KEY_BITS - bits

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), ("piece", pa.bool_()), *((c, pa.binary()) for c in "abcd")])
        for k, batch in enumerate(sub_batches(batches, PIECE_BYTES)):
            uid = part << 32 | k  # the same when a lost task runs again
            sets = shingler(batch.column("text").to_pylist())
            sizes = np.array([s.size for s in sets], np.uint32)
            key = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if key.size else np.zeros(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, key.size))
            one = at[times == 1]
            many, m_times = key[at[times > 1]], times[times > 1].astype(np.uint16)
            member = np.repeat(times > 1, times)
            ids = np.array(batch.column("doc_id").to_pylist(), dtype="<i8") if batch.column("doc_id").null_count == 0 else np.array([-(1 << 63) if x is None else x for x in batch.column("doc_id").to_pylist()], "<i8")
            rows = [(int(uid % (1 << bits)), uid, True, ids.tobytes() + sizes.tobytes(), many.tobytes(), m_times.tobytes(), doc[member].tobytes())]
            s_key, s_doc = key[one], doc[one]
            mask, none = np.uint64((1 << low_bits) - 1), slice(0, 0)
            singles, severals = (dict(bucket_slices(x >> np.uint64(low_bits))) for x in (s_key, many))
            for b in sorted(singles.keys() | severals.keys()):
                s, m = singles.get(b, none), severals.get(b, none)
                # documents in order: runs of equal indices compress, and so do sorted low bits
                o = np.argsort(s_doc[s], kind="stable")
                rows.append((b, uid, False, _pack((s_key[s] & mask)[o]), s_doc[s][o].tobytes(), _pack(many[m] & mask), m_times[m].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _rank(df: np.ndarray) -> np.ndarray:
    """One byte that grows with the number of documents."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)


def _count(table):
    """One bucket: back to each piece go its shingles of two documents or more, with their rank."""
    import pyarrow as pa

    rows = table.to_pylist()
    out = [r for r in rows if r["piece"]]
    own = [r for r in rows if not r["piece"]]
    if own:
        singles, many = [_unpack(r["a"]) for r in own], [_unpack(r["c"]) for r in own]
        times = [np.frombuffer(r["d"], np.uint16) for r in own]
        values = np.concatenate(singles + many)
        weights = np.concatenate([np.ones(sum(s.size for s in singles))] + [t.astype(np.float64) for t in times])
        _, inverse = np.unique(values, return_inverse=True)
        df = np.bincount(inverse, weights)[inverse]
        at, at_many = 0, sum(s.size for s in singles)
        for r, s, m in zip(own, singles, many, strict=True):
            d, dm = df[at : at + s.size], df[at_many : at_many + m.size]
            at, at_many = at + s.size, at_many + m.size
            keep = d >= 2
            if keep.any() or m.size:
                out.append(r | {"a": _pack(s[keep]), "b": np.frombuffer(r["b"], np.uint16)[keep].tobytes(), "c": _rank(d[keep]).tobytes(), "d": _rank(dm).tobytes()})
    return pa.Table.from_pylist(out, schema=table.schema)


def _assemble(bits: int, num: int, den: int):
    low_bits = np.uint64(KEY_BITS - bits)

    def run(table):
        """One piece: each document's size and, if its prefix reaches shared shingles, these rare first."""
        import pyarrow as pa

        rows = table.to_pylist()
        piece = next(r for r in rows if r["piece"])
        own = sorted((r for r in rows if not r["piece"]), key=lambda r: r["bucket"])
        n_docs = len(piece["a"]) // 12
        ids, sizes = np.frombuffer(piece["a"][: 8 * n_docs], "<i8"), np.frombuffer(piece["a"][8 * n_docs :], np.uint32).astype(np.int64)
        many, times, members = np.frombuffer(piece["b"], np.uint64), np.frombuffer(piece["c"], np.uint16), np.frombuffer(piece["d"], np.uint16)
        keys, docs = [], []
        for r in own:
            low = _unpack(r["a"])
            keys.append(np.frombuffer(r["c"], np.uint8).astype(np.uint64) << np.uint64(KEY_BITS) | np.uint64(r["bucket"]) << low_bits | low)
            docs.append(np.frombuffer(r["b"], np.uint16))
        ranks = np.frombuffer(b"".join(r["d"] for r in own), np.uint8).astype(np.uint64)
        keys.append(np.repeat(ranks << np.uint64(KEY_BITS) | many, times))
        docs.append(members)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        cut = np.searchsorted(doc, np.arange(n_docs + 1))
        shared = np.diff(cut)
        prefix = sizes - (num * sizes + den - 1) // den + 1
        live = (sizes > 0) & (sizes - shared < prefix)
        sets = [key[cut[i] : cut[i + 1]].tobytes() if live[i] else None for i in range(n_docs)]
        none = ids == -(1 << 63)
        row = int(piece["uid"]) >> 32 << 44 | (int(piece["uid"]) & 0xFFFFFFF) << 16
        return pa.table({"row": pa.array(row + np.arange(n_docs, dtype=np.int64)), "doc_id": pa.array(ids, pa.int64(), mask=none), "n": pa.array(sizes, pa.int64()), "shared": pa.array(sets, pa.binary())})

    return run


def document_sets(docs: DataFrame, scratch: Scratch, num: int, den: int, shingler=shingle_sets) -> DataFrame:
    """row (unique), doc_id, n (size of the set), shared (binary: its shingles that other documents hold too, rare first, or null if no partner is possible)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, int(total // BUCKET_BYTES).bit_length())
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_split(bits, shingler), _ROW)
    counted = packed.groupBy("bucket").applyInArrow(_count, _ROW)
    return scratch.save(counted.groupBy("uid").applyInArrow(_assemble(bits, num, den), "row long, doc_id long, n long, shared binary"), "sets")


def _postings(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            token, rep, size, pos = [], [], [], []
            for r, n, data in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "shared")), strict=True):
                keys = np.frombuffer(data, "<u8")
                own = n - keys.size
                take = n - (num * n + den - 1) // den + 1 - own
                token.append(keys[:take].view("<i8"))
                rep.append(np.full(min(take, keys.size), r, np.int64))
                size.append(np.full(min(take, keys.size), n, np.int64))
                pos.append(own + np.arange(min(take, keys.size), dtype=np.int64))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, rep, size, pos)], ["token", "rep", "n", "pos"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        """Suffix filter, then the exact overlap, of each candidate pair."""
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb")]
            linked = []
            for _, _, na, nb, sa, sb in zip(*cols, strict=True):
                x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                need = -(-num * (na + nb) // (num + den))
                ok = min(x.size, y.size) >= need
                if ok and x.size > 8:
                    mid = x.size // 2
                    lo = int(np.searchsorted(y, x[mid]))
                    ok = min(mid, lo) + min(x.size - mid, y.size - lo) >= need
                linked.append(bool(ok and np.intersect1d(x, y, assume_unique=True).size >= need))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _crossing(rows: DataFrame, scratch: Scratch, fits, num: int, den: int) -> DataFrame:
    """(a, b) of members of one list and different components that pass the filters.

    A member meets those of its own size class and of larger ones as far as a
    partner may be larger, class by class and block by block: of n members of a
    class each comes n / BLOCK times, and a task gets BLOCK times BLOCK pairs at
    once.
    """
    steps = int(np.ceil(np.log(den / num) / np.log(CLASS))) + 1
    blocks = scratch.save(rows.groupBy("token", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = scratch.save(rows.join(blocks, ["token", "class"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "blocked")
    # The larger one stays in its block; the smaller one goes to all blocks of its class and of the classes above.
    larger = rows.select("token", F.col("class").alias("c"), F.col("block").alias("k"), *(F.col(x).alias(f"o_{x}") for x in ("rep", "n", "pos", "comp")))
    ahead = rows.select("token", "rep", "n", "pos", "comp", F.explode(F.sequence("class", F.col("class") + steps)).alias("c"))
    ahead = ahead.join(blocks.withColumnRenamed("class", "c"), ["token", "c"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    once = (F.col("n") < F.col("o_n")) | (F.col("n") == F.col("o_n")) & (F.col("rep") < F.col("o_rep"))
    pairs = ahead.join(larger, ["token", "c", "k"]).where(once & (F.col("comp") != F.col("o_comp")) & fits("n", "pos", "o_n", "o_pos"))
    return pairs.select(F.col("rep").alias("a"), F.col("o_rep").alias("b"))


def similarity_classes(docs: DataFrame, num: int = 4, den: int = 5, shingler=shingle_sets) -> DataFrame:
    """doc_id, n_shingles, component_id for every row, at similarity num/den of the sets that shingler makes of texts.

    Null, empty and wordless texts have the empty set and no links.  Equal sets
    link.  Repeated rows are nodes of their own with the same set.  A component
    is named by its smallest doc_id; null doc_ids take part but give no name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    sets = document_sets(docs, scratch, num, den, shingler)
    free_shuffles(spark)
    live = sets.where("shared is not null")
    whole = F.octet_length("shared") == 8 * F.col("n")  # a set with shingles of its own equals no other
    keyed = live.select("row", "n", "doc_id", F.when(whole, F.md5("shared")).otherwise(F.col("row").cast("string")).alias("key"))
    classes = scratch.save(keyed.groupBy("n", "key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low")), "classes")
    members = scratch.save(keyed.join(classes, ["n", "key"]).select("row", "rep"), "members")
    reps = scratch.save(live.drop("doc_id").withColumnRenamed("row", "rep").join(classes.select("rep", "low"), "rep"), "reps")
    slim = scratch.save(sets.select("row", "doc_id", F.col("n").alias("n_shingles")), "slim")
    scratch.drop(sets)
    free_shuffles(spark)
    postings = reps.mapInArrow(_postings(num, den), "token long, rep long, n long, pos long")
    need = lambda a, b: F.ceil((a + b) * num / (num + den) - 1e-9)
    # Lists of two or more, without members that even a partner as small as the list has one asks too much of.
    lists = postings.groupBy("token").agg(F.count("*").alias("_c"), F.min("n").alias("_m")).where("_c > 1")
    room = need(F.col("n"), F.greatest("_m", F.ceil(F.col("n") * num / den - 1e-9))) <= F.col("n") - F.col("pos")
    postings = scratch.save(postings.join(lists, "token").where(room).drop("_c", "_m"), "postings")

    edges = tested = labels = None

    def verify(pairs: DataFrame) -> None:
        """Each pair (a < b) once, if not tested before."""
        nonlocal tested, edges
        pairs = pairs.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
        right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
        done = scratch.save(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_verify(num, den), "a long, b long, linked boolean"), "verified")
        tested = done.select("a", "b") if tested is None else tested.union(done.select("a", "b"))
        found = done.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = found if edges is None else edges.union(found)
        del pairs, left, right, done, found
        free_shuffles(spark)

    def labelled(wave: DataFrame) -> DataFrame:
        comp = F.col("rep").alias("comp") if labels is None else F.coalesce("component", "rep").alias("comp")
        rows = wave if labels is None else wave.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        return rows.select("token", "rep", "n", "pos", comp)

    def fits(na: str, pa: str, nb: str, pb: str):
        """Length filter and positional filter; the first shingle that a similar pair shares passes both."""
        a, b = F.col(na), F.col(nb)
        return (a * num <= b * den) & (b * num <= a * den) & (F.least(a - F.col(pa), b - F.col(pb)) >= need(a, b))

    def fitting(rows: DataFrame) -> DataFrame:
        """Members that some member of their list may fit: the smallest partner asks for the least overlap."""
        n, left = F.col("n"), F.col("n") - F.col("pos")
        size = F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS))).cast("int")
        rows = rows.withColumn("class", size)
        # The least size of each class, written so that a long list's members can meet it in several tasks.
        least = scratch.save(rows.groupBy("token", "class").agg(F.min("n").alias("m")), "sizes")
        lists = scratch.save(least.groupBy("token").agg(F.sort_array(F.collect_list("m")).alias("sizes")), "lists")
        smallest = F.get(F.filter("sizes", lambda m: m * den >= n * num), F.lit(0))  # of the classes that are large enough
        floor = F.ceil(n * num / den - 1e-9)  # the class that holds this bound may begin below it
        below = F.exists("sizes", lambda m: (m < floor) & (m * CLASS * CLASS >= floor))
        partner = F.when(below, F.least(floor, F.coalesce(smallest, floor))).otherwise(smallest)
        out = rows.join(lists, "token").where(partner.isNotNull() & (need(n, partner) <= left))
        return out.drop("sizes")

    def against(rows: DataFrame, centre: DataFrame) -> DataFrame:
        """Each list's members against its centre, if they stand in another component."""
        centre = centre.select("token", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("rep", "n", "pos", "comp")))
        pairs = rows.join(centre, "token").where((F.col("comp") != F.col("c_comp")) & fits("n", "pos", "c_n", "c_pos"))
        return pairs.select(F.col("rep").alias("a"), F.col("c_rep").alias("b"))

    def several(rows: DataFrame, order: Column) -> DataFrame:
        """The first member by order of each list that spans two components or more."""
        lists = rows.groupBy("token").agg(F.min(F.struct(order.alias("h"), "rep", "n", "pos", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return scratch.save(lists.where("lo <> hi").select("token", "c"), "centres")

    def united() -> DataFrame:
        """Labels of the links so far; then a star of each component stands for all its links."""
        nonlocal edges
        out = scratch.save(components(edges, scratch), "labels")
        edges = out.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        return out

    # The member with the fewest shingles rarer than the list's is the least changed of a family: most others link to it.
    verify(against(rows := labelled(postings), several(rows, F.col("pos"))))
    labels = united()
    # The same among those that stand apart from it.
    rows = labelled(postings)
    apart = rows.join(several(rows, F.col("pos")).select("token", F.col("c.comp").alias("c_comp")), "token").where("comp <> c_comp").drop("c_comp")
    verify(against(apart, several(apart, F.col("pos"))))
    labels = united()
    rows = labelled(postings)
    verify(against(rows, several(rows, F.xxhash64("rep", F.lit(3)))))
    labels = united()
    # Exact: what still stands apart and shares a prefix shingle; a pair of several shingles is verified once.
    rows = labelled(postings)
    rows = fitting(rows.join(several(rows, F.col("pos")).select("token"), "token"))
    rows = scratch.save(rows, "open")
    verify(_crossing(rows, scratch, fits, num, den))
    labels = components(edges, scratch).withColumnRenamed("node", "rep")
    named = reps.select("rep", "low").join(labels, "rep", "left").select("rep", "low", F.coalesce("component", "rep").alias("comp"))
    names = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    names = scratch.save(named.join(names, "comp").select("rep", "component_id"), "names")
    for table in (reps, postings):
        scratch.drop(table)
    free_shuffles(spark)
    found = members.join(names, "rep").select("row", "component_id")
    return slim.join(found, "row", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more.

    Spark holds on to the last query that ran, so a small one goes between.
    """
    import gc

    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its set and the smallest doc_id that links reach."""
    return similarity_classes(read_table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked ones: that of the smallest doc_id (nulls last), of several the first one.

    Rows are told apart by their place, so rows that share a doc_id or have none
    are judged each by its own text.  docs must give the same rows in the same
    order when read again, as tables do.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    classes = similarity_classes(placed.select(F.col("_place").alias("doc_id"), "text"))
    classes = scratch.save(classes.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "classes")
    several = scratch.save(classes.groupBy("_group").agg(F.count("*").alias("n")).where("n > 1").select("_group"), "groups")
    members = scratch.save(classes.join(several, "_group"), "members")
    known = placed.select("_place", "doc_id").join(members, F.col("_place") == F.col("_row"))
    kept = scratch.save(known.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("k")).select(F.col("k._row").alias("_row")), "kept")
    gone = scratch.save(members.join(kept, "_row", "left_anti").select("_row"), "gone")
    return placed.join(gone, placed["_place"] == gone["_row"], "left_anti").select(*(placed[c] for c in docs.columns))


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS v FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 5 THEN [array_to_string(v, ' ')] ELSE list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' ')) END) AS g FROM w),
d AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)"""

QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLE: dict[str, str] = {"op9_ngram_join": _SQL}
