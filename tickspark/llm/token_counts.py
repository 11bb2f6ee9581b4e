"""Token counts by a map-side two-tier lookup.

A byte-level BPE never merges across pre-tokens, so a text's tokens are the sum
over its pre-tokens.  Tier one is a broadcast table from frequent pre-tokens to
their token counts; its size is bounded by ``table_size`` and it only decides
speed, never a count.  Tier two encodes the misses of a slice of texts in one
call and keeps their counts in a cache of each Python worker.  Nothing is
shuffled: each document is counted in the task that reads it.

Pre-tokens are found by the vocabulary's own pattern, compiled here with the
white space the tokenizer library uses.  Texts with characters beyond the
blocks whose classes are the same in every Unicode version go through the
library's own pre-tokenizer instead, so counts never depend on which Unicode
version two libraries were built with.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import read_table, sub_batches

#: The pre-token pattern of the byte-level vocabulary, white space written out.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters beyond Latin, Greek, Cyrillic and general punctuation take the library's pre-tokenizer.
UNSETTLED = "[^\x00-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞€]"


class _Counter:
    """Counts with one tokenizer; lives in a Python worker for as long as the worker does."""

    def __init__(self, path: str, cache_size: int):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        self.find = regex.compile(PATTERN).findall
        self.unsettled = regex.compile(UNSETTLED).search
        self.special = [t["content"] for t in added]
        self.split = regex.compile("|".join(regex.escape(s) for s in self.special)).split if self.special else None
        self.cache: dict[str, int] = {}
        self.cache_size = cache_size

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special tokens in it."""
        parts, n = [text], 0
        if self.split and any(s in text for s in self.special):
            parts = self.split(text)
            n = len(parts) - 1
        out: list[str] = []
        for part in parts:
            if self.unsettled(part):
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
            else:
                out += self.find(part)
        return out, n

    def count(self, texts: list[str], table: dict[str, int]) -> list[int]:
        if not self.plain:
            return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        split = [self.pieces(t) for t in texts]
        cache = self.cache
        misses = {p for pieces, _ in split for p in set(pieces) if p not in table and p not in cache}
        if misses:
            if len(cache) + len(misses) > self.cache_size:
                cache.clear()
                misses = {p for pieces, _ in split for p in set(pieces) if p not in table}
            todo = list(misses)
            cache.update(zip(todo, (len(e.ids) for e in self.tok.encode_batch(todo, add_special_tokens=False)), strict=True))
        first, second = table.get, cache.__getitem__
        return [n + sum([first(p) or second(p) for p in pieces]) for pieces, n in split]


_COUNTERS: dict[tuple[str, int], _Counter] = {}


def _counter(path: str, cache_size: int) -> _Counter:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, cache_size) not in _COUNTERS:
        _COUNTERS[path, cache_size] = _Counter(path, cache_size)
    return _COUNTERS[path, cache_size]


def frequent_table(docs: DataFrame, path: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens among about sample_rows documents; only speed depends on it."""
    total = docs.count()
    if not total:
        return {}
    counter = _counter(path, 0)
    seen: Counter[str] = Counter()
    if counter.plain:
        for row in docs.where(F.col("text").isNotNull()).select("text").sample(min(1.0, sample_rows / total), seed=7).limit(2 * sample_rows).toLocalIterator():
            seen.update(counter.pieces(row["text"])[0])
    words = [w for w, _ in seen.most_common(table_size) if len(w) <= 64]
    return dict(zip(words, (len(e.ids) for e in counter.tok.encode_batch(words, add_special_tokens=False)), strict=True)) if words else {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, sample_rows: int = 1000, table_size: int = 32_768, cache_size: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text.

    Null counts as empty: 0 tokens.  Special strings inside a text are single
    tokens, as the library has it.  Repeated rows are counted each; further
    columns are not read.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, path, sample_rows, table_size))

    def run(batches):
        import pyarrow as pa

        counter = _counter(path, cache_size)
        for batch in sub_batches(batches, 2_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = counter.count(texts, table.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Bytes and tokens of every row as the library gives them, and whether there are over 1,024 tokens.

    Null and empty texts have none; special strings inside a text are single
    tokens, the library's default; repeated rows are counted each.  A text is
    encoded whole in one task, with some ten times its size of memory.  An empty
    table gives an empty result.  There are no ties to settle.
    """
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
