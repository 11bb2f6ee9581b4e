"""Collocations against counting every phrase in Python."""

import random
import re
from collections import Counter

import pytest

from tickspark.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    held = {}
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i : i + k]] = max(a, held.get((lang, w[i : i + k]), 0))
    out = {}
    for (lang, w), a in cand.items():
        if 100 * held.get((lang, w), 0) >= share * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:j]] + f[lang, w[j:]]), j) for j in range(1, len(w))]
        score, j = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:j]], f[lang, w[j:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def table(seed):
    rng = random.Random(seed)
    words = ["a", "A", "b", "é", "É", "don't", "\x85", " x", "z" * 3, "of", "the", "日本"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["x", "x", "y", None, "und"])))
    return [*rows, (None, None, "x"), (1, "", None), (2, " \n\t", "x"), (3, "a " * 3000 + "b", "x"), rows[0], rows[0]]


def result(df, *args, **kwargs):
    return sorted(tuple(r) for r in col.collocations(df, *args, **kwargs).collect())


@pytest.mark.parametrize("seed, chunk, bucket", [(1, 32_000_000, 1_000_000), (2, 200, 7), (3, 1, 1)])
def test_against_counting(spark, seed, chunk, bucket):
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("id", "chunk", "seq", "word", "words", "n", "f", "rank", "phrase"):
        df = df.selectExpr("*", f"'q' AS {name}")
    want = brute(rows, 8, 4, 80, 2000)
    assert len(want) > 20
    assert result(df, least=8, chunk_bytes=chunk, bucket_pairs=bucket) == want


def test_other_lengths_ties_and_tops(spark):
    rows = table(4)
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, least=5, longest=6, share=50, top=7) == brute(rows, 5, 6, 50, 7)
    assert result(df, least=3, longest=2, top=3) == brute(rows, 3, 2, 80, 3)


def test_nothing_frequent_and_empty(spark):
    assert result(spark.createDataFrame([(1, "one two three", "x")], SCHEMA)) == []
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_long_texts_are_cut_at_pieces():
    text = b"ab cd. " * 900_000
    parts = list(col._slices([text, b"x"]))
    assert len(parts) > 1 and max(map(len, parts)) <= col.SLICE_BYTES
    assert b"\n".join(parts) == (text + b"\nx").translate(col.TABLE)


def test_products_over_64_bits(spark):
    f = 3 * 10**13
    row = spark.createDataFrame([("x", "a b", f, [f * 2, f], [f * 3, f])], "lang string, phrase string, f long, prefix array<long>, suffix array<long>")
    got = col._score(row, 2).first()
    assert (got["a"], got["l"], got["r"], got["score"]) == (f, 2 * f, 3 * f, 2_000_000 // 5)
