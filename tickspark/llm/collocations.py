"""Collocations: frequent phrases of adjacent words by hierarchical pair naming.

Texts become chunks: runs of pieces of one language as numbers, one number a
word.  Words that are frequent in all chunks together get an id.  A phrase of k
words is the pair of the two phrases of k - 1 words that it begins and ends with:
each level replaces adjacent ids by the name of their pair, and a pair counts
where its occurrences over all chunks are frequent.  As parts of a frequent
phrase are frequent, no other pair needs a name.  The pair is kept with the id,
so parents lead from a phrase to all its prefixes and suffixes, which is all that
cuts and subsumption look up.

Chunks deal their distinct pairs, packed, to buckets by a hash of the pair; a
bucket adds up counts, names what is frequent, and answers each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch, bucket_slices, mix64, pair64, read_table, sub_batches

#: Text of a chunk, and of what is split at a time; pairs of a bucket.
CHUNK_BYTES, SLICE_BYTES, BUCKET_PAIRS = 16_000_000, 4_000_000, 1_000_000
#: Of each language so many groups send their best to the last sort.
TOP_GROUPS = 256


def _table() -> bytes:
    """Bytes as they count: A-Z in lower case, ends of pieces as line feeds, tabs as blanks."""
    out = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        out[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = 10
    out[9] = 32
    return bytes(out)


TABLE = _table()


class _Numbers(dict):
    """Numbers of words in order of appearance; 0 is nothing and 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(texts: list[bytes]) -> Iterator[bytes]:
    """The texts one after the other, cut at ends of pieces every few megabytes."""
    data = b"\n".join(texts).translate(TABLE)
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > SLICE_BYTES:
            end = data.rfind(b"\n", start, start + SLICE_BYTES)
            end = end if end > start else data.find(b"\n", start + SLICE_BYTES)
            end = len(data) if end < 0 else end
        yield data[start:end]
        start = end + 1


class _Chunk:
    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, data: bytes) -> None:
        words = data.replace(b"\n", b" \n ").split(b" ")
        seq = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts += [seq[seq != 0], np.ones(1, np.int32)]
        self.size += len(data)

    def row(self, at: int, lang: str) -> dict:
        seq = np.concatenate(self.parts) - 2
        counts = np.bincount(seq[seq >= 0], minlength=len(self.numbers) - 2)
        return {"chunk": at, "lang": lang, "seq": _planes(_closed(np.maximum(seq, -1))), "size": len(self.numbers) - 2, "words": list(self.numbers)[2:], "counts": counts, "total": int(counts.sum())}


def _planes(x: np.ndarray) -> bytes:
    """An array as all its lowest bytes, then the next ones: numbers mostly differ in few of them, so that exchanges pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _closed(seq: np.ndarray) -> np.ndarray:
    """Runs of gaps (-1) as one."""
    return seq[(seq >= 0) | np.append(True, seq[:-1] >= 0)].astype(np.int32)


def _batch(rows: list[dict], schema) -> object:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def _chunks(chunk_bytes: int, schema) -> Callable:
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        at, n, open_chunks = TaskContext.get().partitionId() << 32, 0, {}

        for batch in sub_batches(batches, SLICE_BYTES):
            texts = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for data in _slices(own):
                    open_chunks.setdefault(lang, _Chunk()).add(data)
                    # Bounded in sum, as there can be many languages.
                    if open_chunks[lang].size >= chunk_bytes or sum(c.size for c in open_chunks.values()) >= 2 * chunk_bytes:
                        lang_ = max(open_chunks, key=lambda x: open_chunks[x].size)
                        yield _batch([open_chunks.pop(lang_).row(at + n, lang_)], schema)
                        n += 1
        for lang, chunk in open_chunks.items():
            yield _batch([chunk.row(at + n, lang)], schema)
            n += 1

    return run


def _bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(pair64(left.astype(np.uint64), right.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _pairs(buckets: int, schema) -> Callable:
    """Chunks with the names of their numbers to chunks of pairs, numbered by (bucket, left, right)."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                names = np.full(x["size"] + 1, -1, np.int64)
                for local, ids in zip(x["locals"] or (), x["ids"] or (), strict=True):
                    names[_of_planes(local, np.int32)] = _of_planes(ids, np.int64)
                seq = _of_planes(x["seq"], np.int32)
                seq = _closed(np.where(names[seq] >= 0, seq, -1))  # the last name, of number -1, is no name
                first, second = seq[:-1].astype(np.int64), seq[1:]
                both = (first >= 0) & (second >= 0)
                keys, place, counts = np.unique(first[both] * x["size"] + second[both], return_inverse=True, return_counts=True)
                left, right = names[keys // max(x["size"], 1)], names[keys % max(x["size"], 1)]
                bucket = _bucket(left, right, buckets)
                order = np.lexsort((right, left, bucket))
                number = np.empty(order.size, np.int32)
                number[order] = np.arange(order.size, dtype=np.int32)
                out = np.full(first.size, -1, np.int32)
                out[both] = number[place]
                cut = [(b, s) for b, s in bucket_slices(bucket[order])]
                yield _batch([{"chunk": x["chunk"], "seq": _planes(_closed(out)), "size": order.size, "parts": [{"bucket": b, "start": s.start, "pairs": _planes(np.concatenate([left[order[s]], right[order[s]], counts[order[s]]]))} for b, s in cut]}], schema)

    return run


def _named(least: int) -> Callable:
    """The pairs of a bucket: those that are frequent (no chunk), and which numbers of a chunk they are."""

    def run(part):
        import pandas as pd

        bucket = int(part["bucket"].iloc[0])
        pairs = [_of_planes(p, np.int64).reshape(3, -1) for p in part["pairs"]]
        left, right, counts = np.concatenate(pairs, axis=1)
        order = np.lexsort((right, left))
        fresh = np.append(True, (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1]))
        sums = np.add.reduceat(counts[order], np.flatnonzero(fresh))
        frequent = sums >= least
        ids = np.where(frequent, (bucket << 32) + np.cumsum(frequent) - 1, -1)
        own = np.empty(order.size, np.int64)
        own[order] = ids[np.cumsum(fresh) - 1]
        heads = order[np.flatnonzero(fresh)][frequent]
        rows, at = [(None, left[heads].tobytes(), right[heads].tobytes(), sums[frequent].tobytes(), ids[frequent].tobytes())], 0
        for chunk, start, p in zip(part["chunk"], part["start"], pairs, strict=True):
            mine = own[at : at + p.shape[1]]
            at += p.shape[1]
            kept = np.flatnonzero(mine >= 0)
            if kept.size:
                rows.append((chunk, _planes((kept + start).astype(np.int32)), None, None, _planes(mine[kept])))
        return pd.DataFrame(rows, columns=["chunk", "a", "b", "c", "ids"])

    return run


def _unpacked(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        cells = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("ids", "a", "b", "c")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["id", "left", "right", "f"])


def _packed_names(names: DataFrame) -> DataFrame:
    """(chunk, local, id) rows as one row per chunk and task group, packed as a bucket's answers are."""

    def pack(part):
        import pandas as pd

        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "local": [_planes(part["local"].to_numpy(np.int32))], "ids": [_planes(part["id"].to_numpy(np.int64))]})

    return names.groupBy("chunk").applyInPandas(pack, "chunk long, local binary, ids binary")


def _with_names(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks with all answers to them; those without any have no frequent pair left."""
    own = names.groupBy("chunk").agg(F.collect_list(F.struct("local", "ids")).alias("got"))
    return chunks.join(own, "chunk").select("chunk", "seq", "size", F.col("got.local").alias("locals"), F.col("got.ids").alias("ids"))


def _level(scratch: Scratch, chunks: DataFrame, names: DataFrame, least: int, bucket_pairs: int, most: int, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of pairs, answers to them, and (id, left, right, f) of frequent pairs.  most: bound on the pairs of all chunks."""
    import pyspark.sql.types as T

    buckets = max(1, -(-most // bucket_pairs))
    schema = T.StructType.fromDDL("chunk long, seq binary, size int, parts array<struct<bucket: int, start: int, pairs: binary>>")
    out = scratch.save(_with_names(chunks, names).mapInArrow(_pairs(buckets, schema), schema), f"chunks-{tag}")
    dealt = out.select("chunk", F.inline("parts"))
    answers = scratch.save(dealt.groupBy("bucket").applyInPandas(_named(least), "chunk long, a binary, b binary, c binary, ids binary"), f"answers-{tag}")
    found = scratch.save(answers.where("chunk is null").select("ids", "a", "b", "c").mapInArrow(_unpacked, "id long, left long, right long, f long"), f"pairs-{tag}")
    return out.select("chunk", "seq", "size"), answers.where("chunk is not null").select("chunk", F.col("a").alias("local"), "ids"), found


def _score(phrases: DataFrame, k: int) -> DataFrame:
    """The lowest score over all cuts: floor(2000000 a / (l + r)), the earliest of equal ones."""
    cuts = []
    for j in range(1, k):
        l, r = F.col("prefix")[j - 1], F.col("suffix")[k - j - 1]  # noqa: E741
        score = F.call_function("div", F.col("f").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
    return phrases.withColumn("best", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first of each language, with rank; groups of a language cut to as many before."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(TOP_GROUPS))
    rows = rows.withColumn("_group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_group")


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, chunk_bytes: int = CHUNK_BYTES, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first phrases of 2 to longest words of each language.

    docs: text and lang.  Words are lower case (A-Z), phrases don't cross
    ``.,;:!?`` or line ends.  a counts a phrase, l and r the two sides of its
    lowest-scoring cut, n all words of the language.  A phrase goes if a longer
    candidate that holds it has at least share percent of its occurrences; since a
    longer one by two has a part longer by one with as many, only the next level is
    asked.  Order: score and a descending, phrase in byte order.

    A null lang is ``und``; null, empty and blank texts have no words; repeated rows
    count again; an empty table gives no rows.  A text is cut at ends of pieces,
    so one task holds some 4 MB of it at a time (or its longest piece) and the
    numbers of the words of a chunk.  All other columns are ignored.
    """
    import pyspark.sql.types as T

    scratch = Scratch(docs.sparkSession, "collocations")
    schema = T.StructType.fromDDL("chunk long, lang string, seq binary, size int, words array<binary>, counts array<long>, total long")
    texts = docs.select(_language().alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    chunks = scratch.save(texts.mapInArrow(_chunks(chunk_bytes, schema), schema), "chunks-1")
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("chunk", "lang", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    known = scratch.save(known.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "words")
    names = scratch.save(_packed_names(words.join(known, ["lang", "word"]).select("chunk", "local", "id")), "names-1")
    totals = chunks.groupBy("lang").agg(F.sum("total").alias("n"))
    most = chunks.agg(F.sum("total")).first()[0] or 0

    word = F.col("word").cast("string")
    phrases = known.select("id", "lang", word.alias("phrase"), word.alias("tail"), F.array("f").alias("prefix"), F.array("f").alias("suffix"), "f")
    scored, level = [], phrases
    for k in range(2, longest + 1):
        chunks, names, found = _level(scratch, chunks, names, least, bucket_pairs, most, str(k))
        if k > 2:
            longer = found.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            longer = scratch.save(longer, f"longer-{k}")
            level = level.join(longer, "id", "left").where(F.col("_f").isNull() | (F.col("_f").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * share))
            scored.append(_score(level, k - 1))
        first = phrases.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_head"), "prefix")
        second = phrases.select(F.col("id").alias("right"), "tail", "suffix")
        both = found.join(first, "left").join(second, "right")
        phrases = scratch.save(both.select("id", "lang", F.concat_ws(" ", "_head", "tail").alias("phrase"), "tail", F.concat("prefix", F.array("f")).alias("prefix"), F.concat("suffix", F.array("f")).alias("suffix"), "f"), f"phrases-{k}")
        level = phrases
    scored.append(_score(level, longest))
    rows = scored[0]
    for more in scored[1:]:
        rows = rows.unionByName(more)
    return _first(rows, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of the whole table; a null lang is ``und``."""
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) AS r(k)),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.*, x.a AS l, y.a AS r, j.j AS j, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score FROM c, range(1, 4) AS j(j), f x, f y
  WHERE j.j < c.k AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, j.j), ' ') AND y.phrase = array_to_string(list_slice(c.w, j.j + 1, c.k), ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (SELECT lang, a AS longer, k, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase FROM c, range(2, 4) AS m(m), range(1, 4) AS s(s) WHERE m < k AND s + m - 1 <= k),
held AS (SELECT lang, phrase, max(longer) AS longer FROM part GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
ORACLE = {"op12_collocations": _SQL}
