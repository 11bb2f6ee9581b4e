import re
import zlib
from collections import defaultdict

import pytest

from tickspark.llm import mixing, sharding


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def waterfill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mix(docs, rows):
    got = mixing.mix_table(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes, source = defaultdict(int), {}
    for doc, text, _, src, _ in rows:
        sizes[src] += size(text)
        source[doc] = src
    want, taken, largest = waterfill(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_table(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in got}


def test_mixed_rows(docs, clashing, empty):
    taken = {}
    for r in mixing.mix_table(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"]
    got = mixing.mix_documents(clashing)
    assert got.columns == clashing.columns
    count = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert count == {k: v for k, v in taken.items() if v}
    assert mixing.mix_table(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0


def minimax(sizes, shards):
    def fits(c):
        n, run = 1, 0
        for s in sizes:
            if s > c:
                return False
            if run + s > c:
                n, run = n + 1, 0
            run += s
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_shards(docs, rows, shards):
    got = sharding.shard_table(docs, shards).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    where, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        where[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    sized = docs.select("doc_id", (sharding.F.octet_length(sharding.text_or_empty()) + 16).cast("long").alias("size"), sharding.group_key(sharding.text_or_empty()).alias("g"))
    giants, _, capacity = sharding.minimax_cuts(sized, shards)
    by_group = {r["g"]: r["s"] for r in sized.groupBy("g").agg(sharding.F.sum("size").alias("s")).collect()}
    rest = [by_group[g] for g in sorted(by_group) if g not in giants]
    assert capacity == minimax(rest, shards - len(giants))
    assert max(load.values()) == max([capacity, *(by_group[g] for g in giants)]) or max(load.values()) <= capacity


def test_shards_keep_columns(clashing, empty):
    got = sharding.shard_documents(clashing, 4)
    assert got.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert got.count() == clashing.count()
    assert sharding.shard_table(empty, 4).count() == 0
