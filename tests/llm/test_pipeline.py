from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_dedup import groups, jaccard, shingles
from test_mixing_sharding import size, waterfill
from test_models import words_of

import __spark_entry__ as entry


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", ["empty", "clashing"])
def test_stages_keep_columns(sf, request, name):
    docs = request.getfixturevalue(name)
    given = {r["doc_id"]: r for r in docs.collect()}
    for stage, f in corpus_pipeline.STAGES[:-1]:
        out = f(docs.sparkSession, docs, sf)
        assert out.columns == docs.columns, stage
        assert all(r == given[r["doc_id"]] for r in out.collect()), stage


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        before = docs.collect()
        f(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())

    before, after = seen["language_id"]
    ids = {r["doc_id"] for r in after}
    assert all(any(c.isalpha() for c in r["text"]) for r in after)
    gone = [r for r in before if r["doc_id"] not in ids]
    assert len([r for r in gone if any(c.isalpha() for c in r["text"] or "")]) <= 0.01 * len(before)

    before, after = seen["near_duplicates"]
    sets = [shingles(r["text"]) for r in before]
    name_of = {}
    for r, g in zip(before, groups(sets, jaccard), strict=True):
        name_of.setdefault(g, []).append(r["doc_id"])
    assert {r["doc_id"] for r in after} == {min(v) for v in name_of.values()}

    before, after = seen["decontamination"]
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    held = set()
    for r in before:
        w = words_of(r["text"])
        have = set(gram(w))
        for v in items:
            want = Counter(gram(v))
            if have & set(want):
                for s in range(-len(v), len(w)):
                    got = Counter(gram(w[max(s, 0) : max(0, s + len(v))]))
                    common = sum((got & want).values())
                    if common and common / (sum(got.values()) + sum(want.values()) - common) >= 0.8:
                        held.add(r["doc_id"])
                        break
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - held

    before, after = seen["mixing"]
    words, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        words[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    for r in after:
        taken[r["source"]] += size(r["text"])
    assert set(after) <= set(before) and max(Counter(r["doc_id"] for r in after).values()) <= 2
    for source, want in waterfill(dict(words)).items():
        assert abs(taken[source] - want) <= largest[source]

    before, after = seen["sharding"]
    key = lambda r: (r["doc_id"], r["text"])
    assert Counter(map(key, before)) == Counter(map(key, after))
    where, slots = defaultdict(set), defaultdict(list)
    for r in after:
        where[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert got.count() > 0
