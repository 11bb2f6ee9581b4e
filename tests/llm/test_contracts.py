"""Contract columns of personal data and languages against plain forms of them, and very long texts and ties."""

import hashlib
import random
import re

import numpy as np

from tickspark.llm import language_id, pii, quality, sharding, suffix_dedup, token_counts

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), KINDS.index(k), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal(seed):
    rng = random.Random(seed)
    parts = ["a.b@c-d.org", "x@y", "é me@h.co@z.io", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4929348385146306", "4929 3483 8514 6306", "4929-3483-8514-6307", "+1 (017) 555-7713", "+12", "+49 30 123456", "000000000000", "7" * 25, "日本 ", "\n", "word", "12", "@", ".", "+", "-", " "]
    return "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 12)))


def test_base_columns_of_whole_documents(spark, docs, rows, tagger):
    texts = [*[r[1] for r in rows], *map(personal, range(400)), "pad " * 30_000 + "mail q@w.er and 10.0.0.1 " + "x " * 450_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df, tagger).collect()}
    for i, text in enumerate(texts):
        want = base(text or "")
        r = got[i]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(KINDS[s[1]] == k for s in want) for k in KINDS], text
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in joined(want).split(",") if s and s not in spans] == []
        assert len(spans) == len(want) + r["n_added"]
        at = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for s in spans]
        # Added ones lie within the text and overlap no other; all are in order.
        added = [s for s in at if s not in want]
        assert all(0 <= a < b <= len(text) for a, _, b in added)
        assert all(b <= c or a >= d for a, _, b in added for c, _, d in at if (a, b) != (c, d))
        assert at == sorted(at)


def test_no_span_is_cut_by_its_windows():
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 48)
        before, after = rng.randint(0, 300), rng.randint(0, 300)
        at = rng.randrange(n)
        text = "a" * before + "b" * at + "@" + "b" * (n - at - 1) + "a" * after
        starts = pii._windows(text)
        assert starts == sorted(set(starts))
        inside = [a for a in starts if (a < before or a == 0) and (before + n < a + pii.WINDOW or a + pii.WINDOW >= len(text))]
        whole = [a for a in starts if a <= before and before + n <= a + pii.WINDOW]
        assert whole and (inside or n > 46), (before, n, at, starts)


def test_folded_scores_are_those_of_the_embeddings(languages):
    model = languages
    rng = random.Random(1)
    texts = ["the of und die", "Ä", "über " * 50, "日本語 text", *("".join(rng.choice("abcdeäöü \n.") for _ in range(rng.randint(1, 200))) for _ in range(50))]
    texts = [t for t in texts if language_id.has_letter(t)]
    want = []
    for at, f in language_id._features(texts):
        z = (f.astype(float) @ model.table[at].astype(float) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        want.append(p / p.sum())
    got = model.scores(texts)
    assert np.allclose(got, want, atol=1e-5)
    lang, score = model.predict(texts)
    assert [model.langs.index(x) for x in lang] == [int(p.argmax()) for p in got] and np.allclose(score, got.max(1))


def test_unsure_texts_with_letters_are_rejected(spark):
    """Five languages whose labels say nothing: no score is sure, so the threshold rises to its bound and texts go."""
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "sed", "quia", "non"]
    noise = [(" ".join(rng.choice(words) for _ in range(30)), rng.choice("abcde")) for _ in range(200)]
    model = language_id.train(noise, steps=500)
    assert model.threshold == language_id.MAX_THRESHOLD
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(noise)], "doc_id long, text string")
    out = language_id.identify(df, model).collect()
    assert all(r["accepted"] == (r["score"] >= model.threshold) and r["lang_pred"] in "abcde" for r in out)
    assert sum(not r["accepted"] for r in out) > len(out) / 2
    kept = {r["doc_id"] for r in language_id.keep_accepted(df, model).collect()}
    assert kept == {r["doc_id"] for r in out if r["accepted"]}


def test_equal_scores_go_to_the_first_language():
    model = language_id.Model(["aa", "bb"], np.zeros((1 << language_id.BITS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    assert model.predict(["some text"]) == (["aa"], [0.5])


def test_texts_longer_than_any_batch(spark):
    import public_tokenizers

    long = "some plain words, and numbers 123. " * 80_000
    rows = [(1, long, "en", "s", 0), (2, "short one", "en", "s", 0), (3, long, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tokens = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert tokens[1] == tokens[3] and tokens[1][0] == len(long) and tokens[1][1] > 80_000 * 8
    measured = {r["doc_id"]: r for r in quality.ledger(df).collect()}
    assert (measured[1]["n_words"], measured[1]["word_chars"], measured[1]["n_repeat_words"]) == (80_000 * 6, len(long.replace(" ", "")), 80_000 * 6)
    shards = {r["doc_id"]: r["size"] for r in sharding.shard_table(df, 2).collect()}
    assert shards == {1: len(long) + 16, 2: 9 + 16, 3: len(long) + 16}
    model = language_id.train([("the of and to in that " * 5, "en"), ("der die und den das von " * 5, "de")] * 10, steps=500)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()}
    assert got[1] == got[3] in ("en", "de")
    assert len(long) > suffix_dedup.PIECE_BYTES


def test_repeats_in_a_text_longer_than_a_piece(spark):
    rng = random.Random(4)
    unique = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = unique(600)
    a = unique(700_000) + "(" + passage + ")" + unique(600_000)
    rows = [(1, a), (2, unique(300) + "[" + passage + "]" + unique(100)), (3, unique(500))]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    # The characters beside the passage differ, so nothing else repeats.
    assert [got[k]["n_removed"] for k in (1, 2, 3)] == [600, 600, 0]
    assert got[2]["kept_sha256"] == hashlib.sha256(rows[1][1].replace(passage, "").encode()).hexdigest()
