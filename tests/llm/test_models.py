import hashlib
import re
import zlib

import numpy as np
import pytest

from tickspark.llm import decontaminate, language_id, pii, quality, token_counts


def test_language_id(docs, rows, empty, clashing, languages):
    model = languages
    out = language_id.identify(clashing, model)
    assert set(clashing.columns) | {"score", "accepted"} == set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    for doc in (20, 21, 22, 25):
        assert (got[doc]["lang_pred"], got[doc]["score"], got[doc]["accepted"]) == ("und", 0.0, False)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1 and (r[0] < 10 or r[0] > 33)]
    assert len(held) > 8
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.fit(empty)
    assert language_id.identify(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, model).count() == 0


def test_language_model_never_sees_the_held_out_third(spark, docs):
    sample = language_id.labelled_sample(docs, 100)
    texts = {r["text"] for r in docs.where(~language_id.held_out()).select("text").collect()}
    assert sample and all(t in texts for t, _ in sample)


def test_pii_base_rules():
    text = "mail a.b@c-d.org. x@y 1.2.3.4 x 300.1.1.1 y 4929348385146306, 4929348385146307; +1 (017) 555-7713 +12 é me@h.co@z.io"
    got = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert got == [("email", "a.b@c-d.org"), ("ip", "1.2.3.4"), ("card", "4929348385146306"), ("phone", "+1 (017) 555-7713"), ("email", "me@h.co")]
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(0)
    for _ in range(3000):
        t = "".join(rng.choice(list("a@.-+1 %é"), 14))
        assert [(m.start(), m.end()) for m in pattern.finditer(t)] == [(a, b) for a, k, b in pii.base_spans(t) if k == 0], t
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(rng.choice(list("12.3.."), 14))
        want = [(m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        assert want == [(a, b) for a, k, b in pii.base_spans(t) if k == 1], t


def test_pii_gradients():
    m = pii.Tagger(4, 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (3, 9)), np.zeros((3, 9), np.int8)
    y[0, 2], y[0, 3], y[1, 4], y[1, 5:8] = 1, 2, 7, 8
    _, g = m.loss_and_grads(x, y)
    for k in m.p:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in m.p[k].shape)
            if k == "trans" and not m.allowed[at]:
                continue
            old, losses = m.p[k][at], []
            for d in (1e-3, -1e-3):
                m.p[k][at] = old + d
                losses.append(m.loss_and_grads(x, y)[0])
            m.p[k][at] = old
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[k][at], abs=1e-4)


def test_pii_model(docs, rows, empty, tagger):
    model = tagger
    rng = np.random.default_rng(5)
    hit = total = false = 0
    for _ in range(150):
        item, kind = pii._synthetic(rng)
        text = "of words and lines there is much " + item + " and more of them too"
        base = pii.base_spans(text)
        spans = base + pii.added_spans(model, [text], [base])[0]
        if kind is None:
            false += len(spans) > len(base)
        else:
            total += 1
            hit += (33, kind, 33 + len(item)) in spans
    assert hit >= 0.9 * total and false <= 3
    got = {r["doc_id"]: r for r in pii.find_pii(docs, model).collect()}
    assert got[20]["spans"] == "" and got[20]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(got) == len({r[0] for r in rows})
    assert pii.find_pii(empty, pii.Tagger()).count() == 0


def test_pii_windows_reach_every_trigger():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join("1" if x < 0.02 else "a" for x in rng.random(700))
        starts = pii._windows(text)
        assert starts == sorted(set(starts))
        for i, c in enumerate(text):
            if c == "1":
                assert any(s + min(s, 1) * 8 <= i < s + pii.WINDOW - 8 or (s <= i and s + pii.WINDOW >= len(text)) for s in starts), (i, starts)


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, path, table_size=50, cache_size=300).collect())
    want = []
    for r in rows:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty, path).count() == 0
    lower = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(docs, lower).where("doc_id = 23").first()["n_tokens"] == len(Tokenizer.from_file(lower).encode("one two", add_special_tokens=False).ids)


def test_token_counts_of_odd_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), token_counts._Counter(path, 1000)
    rng = np.random.default_rng(2)
    pool = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　'sdtre 019²¼ªºàßǅ́日한🙂aA.,!") + ["'ll", "'ve", "<|endoftext|>", "  ", "١", "ⅷ"]
    texts = ["".join(rng.choice(pool, rng.integers(1, 25))) for _ in range(1500)]
    assert own.count(texts, {}) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = {}
    for i in range(len(words) - 7):
        count.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in count.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, rows, empty):
    ledger = quality.ledger(docs).cache()
    got = sorted((r["doc_id"], *(r[m] for m in quality.MEASURES[:5]), bool(r["failed"] & quality.BASE.mask)) for r in ledger.collect())
    want = []
    for r in rows:
        m = brute_quality(r[1])
        want.append((r[0], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want)
    kept = quality.apply_policy(ledger, quality.PRODUCTION)
    assert kept.where("kept").count() > 40
    table = {r["rule"]: r for r in quality.ablations(ledger, quality.PRODUCTION).collect()}
    for name, bit in quality.BIT.items():
        rest = quality.Policy("x", tuple(n for n in quality.BIT if n != name))
        assert table[name]["n_kept_without"] == quality.apply_policy(ledger, rest).where("kept").count()
        assert table[name]["n_failed"] == ledger.where(f"failed & {bit} <> 0").count()
    assert quality.ledger(empty).count() == 0


def words_of(t):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def test_decontaminate(spark, docs, rows, empty):
    items = [(0, rows[2][1][:200]), (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "one two"), (5, rows[3][1][100:420])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = [(500, "x y z ALPHA, beta gamma; delta epsilon zeta eta theta iota kappa! end", "en", "s", 0), (501, "alpha beta gamma delta epsilon", "en", "s", 0)]
    every = rows + extra
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(every, docs.schema), bench).collect()}
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    want = set()
    for r in every:
        w = words_of(r[1])
        for item, text in items:
            v = words_of(text)
            for s in range(-len(v), len(w)):
                window = w[max(s, 0) : max(0, s + len(v))]
                a, b = gram(window), gram(v)
                common = sum(min(a.count(g), b.count(g)) for g in set(a))
                if common and common / (len(a) + len(b) - common) >= 0.8:
                    want.add((r[0], item))
    assert got == want
    assert (500, 1) in got and (501, 1) not in got
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in kept.collect()}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def brute_force_contaminated(texts, items):
    """(doc_id, item_id) of every window of the item's size, at the borders the part inside, that is similar enough."""
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    want = set()
    for doc, text in texts:
        w = words_of(text)
        for item, passage in items:
            v = words_of(passage)
            for s in range(-len(v), len(w)):
                a, b = gram(w[max(s, 0) : max(0, s + len(v))]), gram(v)
                common = sum(min(a.count(g), b.count(g)) for g in set(a))
                if common and common / (len(a) + len(b) - common) >= 0.8:
                    want.add((doc, item))
    return want


def test_short_items_are_found_in_longer_documents(spark):
    items = [(1, "one"), (2, "One two"), (3, "one, two three"), (4, "one two three four"), (5, "one two three four five"), (6, "two two")]
    texts = [(0, "a b c d e one two f g"), (1, "x one two three"), (2, "one two three four five six"), (3, "two one"), (4, "ONE"), (5, "a b c d e f"), (6, "zero two two two three four"), (7, "")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_force_contaminated(texts, items)
    assert {(0, 1), (0, 2), (1, 3), (2, 4), (6, 6)} <= want
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert [(r["start"], r["n_words"], r["similarity"]) for r in got if (r["doc_id"], r["item_id"]) == (0, 2)] == [(5, 2, 1.0)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(df, bench.where("item_id = 2")).orderBy("doc_id").collect()] == [3, 4, 5, 6, 7]


def test_windows_are_laid_off_the_diagonals_too(spark):
    import random

    rng = random.Random(3)
    items, texts = [], []
    for i, m in enumerate((50, 45, 59, 40, 12, 6, 3)):
        w = [f"w{i}x{j}" for j in range(m)]
        if i == 3:
            w[20:30] = w[:10]  # repeated shingles
        items.append((i, " ".join(w)))
        out = [[f"o{j}" for j in range(70)] for _ in range(2)]
        for cut in (m // 2, m // 3, m // 5):
            texts.append([*out[0], *w[cut:], *w[:cut], *out[1]])
            texts.append([*w[cut:], *w[:cut]])
        for missing in range(0, 1 + m // 3, 2):
            texts += [[*w[missing:], *out[1]], [*out[0], *w[: m - missing]], w[missing:]]
            at = rng.randrange(m)
            texts.append([*out[0], *w[:at], *out[1][:missing], *w[at:], *out[1]])
        texts.append([*out[0], *w, *out[1], *w, *w[5:]])
    texts = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = brute_force_contaminated(texts, items)
    assert (0, 0) in want and len(want) > 40
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    swapped = next(r for r in got if (r["doc_id"], r["item_id"]) == (0, 0))
    assert (swapped["start"], swapped["n_words"], swapped["hamming"]) == (70, 50, 0) and 0.8 <= swapped["similarity"] < 0.85


def test_the_radius_keeps_windows_of_borderline_similarity(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(60))) for i in range(400)]
    # 50 of 62 shingles, and too far inside for a window over a border.
    texts = [(i, " ".join([*["before"] * 60, *[f"i{i}w{j}" for j in range(54)], *[f"d{i}w{j}" for j in range(66)]])) for i in range(400)]
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(400)]


def test_simhash_blocks_cover_the_radius(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(200):
        a = int(rng.integers(-(1 << 62), 1 << 62))
        b = a
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(bit) if bit < 63 else -(1 << 63)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    met = df.where(F.arrays_overlap(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b"))))
    assert met.count() == len(pairs)


def test_samples_are_bounded_whatever_ids_repeat(spark, monkeypatch):
    rows = [(None if i % 2 else 7, f"text number {i} of many words", "en") for i in range(3000)] + [(None, "the same text 12", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    monkeypatch.setattr(pii, "training_windows", lambda texts: seen.append(len(texts)) or (None, None))
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, x, y: None)
    real = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (seen.append(len(out := real(self))), out)[1])
    pii.fit(docs, 50)
    assert 0 < max(seen) <= 150
    seen.clear()
    language_id.labelled_sample(docs, 50)
    assert 0 < max(seen) <= 150


def test_clashing_columns_change_no_result(docs, clashing):
    import public_tokenizers

    bench = docs.select(docs.doc_id.alias("item_id"), "text").where("item_id = 4")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for f in (lambda d: decontaminate.contaminated(d, bench), lambda d: pii.find_pii(d, pii.Tagger()), lambda d: token_counts.count_tokens(d, path), lambda d: quality.ledger(d).select("doc_id", "n_words")):
        assert sorted(map(str, f(clashing).collect())) == sorted(map(str, f(docs).collect()))
