"""Benchmark decontamination with SimHash windows (DataFrame functions only).

Words are lower-cased runs of letters and digits, shingles five words.  An item
of fewer words is one shingle, and meets every run of as many words.  A window
of a document has as many words as a benchmark item.  Every window is laid that
holds enough of one item's shingles to verify, in whatever order: a window that
shares c shingles has at most the similarity c / (own + item's - c), so others
can't.  A window's fingerprint is a 64-bit SimHash of its words.  Fingerprints are
cut into RADIUS + 1 blocks; two within RADIUS bits agree in a block, so an
equi-join on (item size, block number, block bits) finds every item within the
radius.  Those are verified by
the exact weighted Jaccard similarity of the two shingle multisets, a shingle
weighing as often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch, identity, read_table

SHINGLE = 5
RADIUS = 15
SIMILARITY = 0.8
#: Item shingles up to this number are broadcast (24 bytes each); beyond it the join is left to shuffle.
BROADCAST_SHINGLES = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    """Hashes of all runs of SHINGLE words; a shorter text is one shingle, an empty one none."""
    size = F.size(hashes)
    full = F.transform(F.sequence(F.lit(1), size - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + (k - 1)) for k in range(SHINGLE)]))
    short = F.array(F.aggregate(hashes, size.cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    return F.when(size >= SHINGLE, full).when(size > 0, short).otherwise(F.array().cast("array<bigint>"))


def short_runs(hashes: Column, m: int) -> Column:
    """Hashes of all runs of m < SHINGLE words, each as shingles() hashes a text of m words."""

    def run(i: Column) -> Column:
        out = F.lit(m).cast("long")
        for k in range(m):
            out = F.xxhash64(out, F.get(hashes, i + k))
        return out

    return F.when(F.size(hashes) >= m, F.transform(F.sequence(F.lit(0), F.size(hashes) - m), run)).otherwise(F.array().cast("array<bigint>"))


def placed(grams: Column) -> Column:
    """(pos, gram) of each."""
    return F.transform(grams, lambda g, i: F.struct(i.alias("pos"), g.alias("gram")))


def words_and_grams(text: Column) -> Column:
    """Generator of the columns words and grams; the lambda binds the words, else every shingle would split the text anew."""
    return F.inline(F.transform(F.array(word_hashes(text)), lambda w: F.struct(w.alias("words"), shingles(w).alias("grams"))))


def starts(at: Column, k: Column, g: Column, lo: Column, hi: Column) -> Column:
    """Each start from lo to hi of a window of g shingles that holds k or more of the ascending positions at."""

    def of(i: Column) -> Column:
        # Windows that hold the position before too are given there; greatest skips the null before the first.
        first = F.greatest(F.get(at, i + k - 1) - g + 1, F.get(at, i - 1) + 1, lo)
        last = F.least(F.get(at, i), hi)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(at) >= k, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - k), of))).otherwise(F.array().cast("array<int>"))


def window_starts(at: Column, m: Column, size: Column) -> Column:
    """Starts of all windows of m words that can verify, in a text of size words with an item's shingles at the positions at."""
    g = F.greatest(m - (SHINGLE - 1), F.lit(1))
    least = lambda share: F.ceil(g * share - 1e-9).cast("int")
    whole, part = least(2 * SIMILARITY / (1 + SIMILARITY)), least(SIMILARITY)
    inside = starts(at, whole, g, F.lit(0), size - m)
    # A window over a border has fewer shingles than the item, so fewer common ones can do.
    return F.concat(inside, starts(at, part, g, -m, F.lit(-1)), starts(at, part, g, F.greatest(size - m + 1, F.lit(0)), size))


def fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is set if it is set in more than half of the word hashes."""

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, x: n + F.call_function("bit_get", x, b).cast("int"))
        return acc.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def blocks(fp: Column) -> Column:
    """(block number, block bits) of a fingerprint, RADIUS + 1 blocks of equal width or one bit more."""
    n = RADIUS + 1
    edges = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1).cast("long")).alias("bits")) for k in range(n)])


def fingerprint_and_blocks(hashes: Column) -> Column:
    """Generator of the columns fp and blocks, the fingerprint computed once."""
    return F.inline(F.transform(F.array(fingerprint(hashes)), lambda f: F.struct(f.alias("fp"), blocks(f).alias("blocks"))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two multisets given as arrays."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))
    return common / (F.size(a) + F.size(b) - common)


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, m (words), grams (shingles), fp and blocks of all items with a word."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", words_and_grams(F.col("text"))).where(F.size("words") > 0).withColumn("m", F.size("words"))
    return items.select("item_id", "m", "grams", fingerprint_and_blocks(F.col("words")))


def verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k1 and k2 (of the row), item_id, start, window, hamming, similarity of every window that verifies."""
    items = item_table(benchmark)
    entries = items.select("item_id", "m", F.explode("grams").alias("gram")).distinct()
    n, short = items.agg(F.sum(F.size("grams")), F.sort_array(F.collect_set(F.when(F.col("m") < SHINGLE, F.col("m"))))).first()
    n = n or 0
    if n <= BROADCAST_SHINGLES:
        entries = F.broadcast(entries)
    texts = docs.where(F.col("text").isNotNull())
    grams = F.concat(placed(F.col("grams")), *[placed(short_runs(F.col("words"), m)) for m in short])
    # Only the size of the text stays beside each of its shingles.
    hits = texts.select("doc_id", *identity(), words_and_grams(F.col("text"))).select("doc_id", "k1", "k2", F.size("words").alias("size"), grams.alias("placed"))
    hits = hits.select("doc_id", "k1", "k2", "size", F.inline("placed")).join(entries, "gram")
    met = hits.groupBy("doc_id", "k1", "k2", "size", "item_id", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    spots = met.select("doc_id", "k1", "k2", "m", F.explode(window_starts(F.col("at"), F.col("m"), F.col("size"))).alias("start"))
    spots = spots.groupBy("doc_id", "k1", "k2").agg(F.collect_set(F.struct("m", "start")).alias("spots"))
    # Written, as its size then decides how it is joined: few texts are cut a second time.
    spots = Scratch(docs.sparkSession, "decontaminate").save(spots, "spots").withColumnsRenamed({"doc_id": "_doc", "k1": "_k1", "k2": "_k2"})
    texts = texts.select("doc_id", "text", *identity()).join(spots, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    texts = texts.select("doc_id", "k1", "k2", "spots", F.explode(F.array(word_hashes(F.col("text")))).alias("words"))
    windows = texts.select("doc_id", "k1", "k2", "words", F.inline("spots"))
    start = F.col("start")
    windows = windows.select("doc_id", "k1", "k2", "m", "start", F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("m") + F.least(start, F.lit(0))).alias("window"))
    windows = windows.select("*", fingerprint_and_blocks(F.col("window"))).select("doc_id", "k1", "k2", "m", "start", "window", "fp", F.explode("blocks").alias("block"), F.col("blocks"))
    index = items.select("item_id", "m", "grams", F.col("fp").alias("item_fp"), F.col("blocks").alias("item_blocks"), F.explode("blocks").alias("block"))
    if n <= BROADCAST_SHINGLES:
        index = F.broadcast(index)
    near = windows.join(index, ["m", "block"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= RADIUS)
    # A pair meets in several blocks: keep it in the first.
    near = near.where(F.array_min(F.transform(F.array_intersect("blocks", "item_blocks"), lambda x: x["no"])) == F.col("block.no"))
    near = near.select("doc_id", "k1", "k2", "item_id", "start", "window", "hamming", "grams", F.explode(F.array(shingles(F.col("window")))).alias("own"))
    return near.withColumn("similarity", weighted_jaccard(F.col("own"), F.col("grams"))).where(F.col("similarity") >= SIMILARITY)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (0-based word), n_words, hamming, similarity: the best window of each document and item it holds.

    Null, empty and wordless texts and items match nothing.  Repeated rows give
    one result.  A window over a document's border is the part inside.  Of equally
    similar windows the nearest fingerprint, then the first start is given.  A
    text's words are an array of 8 bytes a word and its shingles one of 16 bytes,
    in one task.  Further columns are ignored.
    """
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), F.size("window").alias("w"))).alias("b")
    out = verified(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.w").cast("long").alias("n_words"), (-F.col("b.h")).cast("int").alias("hamming"), F.col("b.similarity").alias("similarity"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (document, item) pairs of all documents and all benchmark items, as contaminated() defines them."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; rows of one doc_id, null included, are judged each by its own text."""
    held = verified(docs.select("doc_id", "text"), benchmark).select(F.col("k1").alias("_held1"), F.col("k2").alias("_held2")).distinct()
    of_row = F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(F.lit(1), docs["doc_id"], docs["text"])
    return docs.join(held, (of_row[0] == held["_held1"]) & (of_row[1] == held["_held2"]), "left_anti").select(*(docs[c] for c in docs.columns))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE: dict[str, str] = {}
