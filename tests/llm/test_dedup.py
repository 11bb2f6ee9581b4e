import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import line_dedup, ngram_join, suffix_dedup
from tickspark.llm.common import Scratch
from tickspark.llm.components import components


def covered(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        out.append(np.cumsum(m[:-1]) > 0)
    return out


@pytest.mark.parametrize("length", [40, 100, 400])
def test_suffix_dedup(docs, rows, length):
    got = {(r["doc_id"], r["kept_sha256"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs, length).collect()}
    texts = [(r[1] or "").encode() for r in rows]
    want = set()
    for r, b, c in zip(rows, texts, covered(texts, length), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~c]) if b else b""
        spans = int((c & ~np.concatenate([[False], c[:-1]])).sum()) if b else 0
        want.add((r[0], hashlib.sha256(kept).hexdigest(), len(b), int(c.sum()), spans))
    assert got == want


def test_suffix_dedup_of_periodic_and_repeated_text(spark, empty):
    texts = ["ab" * 300, "x" * 450, "x" * 399, "abc" * 134, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 600), (1, 450), (2, 0), (3, 402), (3, 402), (4, 0), (5, 0)]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def words_shared(rows, length):
    """Words of each row in sequences of length words that a row with another doc_id or text has too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    where = defaultdict(set)
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(r[:2])
    out = []
    for w in words:
        at = {j for i in range(len(w) - length + 1) if len(where[tuple(w[i : i + length])]) > 1 for j in range(i, i + length)}
        out.append(len(at))
    return out


@pytest.mark.parametrize("length", [5, 51])
def test_words_shared_with_other_documents(spark, rows, length):
    rng = random.Random(length)
    plain = [tuple(r[:2]) for r in rows]
    # Few different words: windows meet within documents, within and between stretches of one name, and in repeated rows.
    plain += [(100 + i, " ".join(rng.choice("abc") * (1 + (rng.random() < 0.1)) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    plain += [(200 + i, ("a " * 55 + "b ") * rng.randint(1, 3) + f"c{i % 4} ") for i in range(8)] + [(300, "x y " * 90), (301, "q w e r t " * 40), (301, "q w e r t " * 40)]
    # A stretch twice in one document, of which another document has a part.
    for i in range(400, 440, 2):
        part = [str(rng.random()) for _ in range(110)]
        plain += [(i, " ".join([*part, f"u{i}", *part])), (i + 1, " ".join([f"v{i}", *part[20:75], f"w{i}"]))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(plain, "doc_id long, text string").repartition(5), passage_words=length)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = words_shared(plain, length)
    assert sum(n > 0 for n in want) > 10
    assert sorted((r["doc_id"], r["n_bytes"], r["n_shared_words"]) for r in got.collect()) == sorted((d, len((t or "").encode()), n) for (d, t), n in zip(plain, want, strict=True))


def test_query_finds_short_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(8)
    unique = lambda n, size=9: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))
    passage, short, own = unique(51, 5), unique(50), unique(60)
    assert len(passage.split()) == 51 and len(passage) < 400
    texts = [f"{unique(90)} {passage} {unique(80)}", f"{unique(10)} {passage}\n{unique(30)}", f"{unique(40)}\n{own} z {own}", f"{short} {unique(9)}", f"{unique(9)} {short}", unique(200), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffix_dedup.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["n_shared_words"] for i in range(8)] == [51, 51, 0, 0, 0, 0, 0, 0]
    # Fewer than 400 bytes stay; a string of 400 bytes goes, in one document too.
    assert [got[i]["n_removed"] for i in range(8)] == [0, 0, 2 * len(own), len(short), len(short), 0, 0, 0]
    assert got[0]["kept_sha256"] == hashlib.sha256(texts[0].encode()).hexdigest()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(sets, link):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if link(sets[i], sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def jaccard(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def test_ngram_join(docs, rows):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    extra = []
    for k in range(40):  # a family in which not all are alike
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        extra.append((1000 + k, " ".join(words), "en", "s0", 0))
    every = rows + extra
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_classes(docs.sparkSession.createDataFrame(every, docs.schema).repartition(4)).collect())
    sets = [shingles(r[1]) for r in every]
    root = groups(sets, jaccard)
    name = defaultdict(list)
    for r, g in zip(every, root, strict=True):
        name[g].append(r[0])
    want = sorted((r[0], len(s), min(name[g])) for r, s, g in zip(every, sets, root, strict=True))
    assert got == want


def test_long_words_that_only_a_sum_takes_for_equal(spark):
    """A Thue-Morse word and its complement differ; sums modulo a power of two don't tell."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_long_texts_that_share_most_words(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**9)}" for _ in range(20_000)]
    texts = []
    for k in range(3):
        words = list(base)
        a = 6000 * k
        words[a : a + 1500] = [f"n{rng.randrange(10**9)}" for _ in range(1500)]
        texts.append((k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in texts]
    assert [got[k] for k in range(3)] == [0 if jaccard(sets[0], sets[k]) or k == 0 else k for k in range(3)]


def test_keep_one(docs, clashing, empty):
    kept = ngram_join.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 4 in ids and not ids & {10, 11, 13}
    assert ngram_join.similarity_classes(empty).count() == 0


def test_one_row_of_each_class_whatever_the_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(None, text), (None, text), (7, other), (7, other), (7, "else"), (3, text + " more"), (None, None), (None, None), (9, "")]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, text + " more"), (7, other), (7, "else"), (None, None), (None, None), (9, "")], key=repr)


@pytest.mark.parametrize("block", [2, 256])
def test_lists_in_classes_and_blocks(spark, monkeypatch, block):
    """Families around one template, with links and without, of sizes that filters keep and drop."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    template = [f"t{i}" for i in range(90)]
    texts = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(rng.randint(4, 34))]
        if i % 3 == 0:
            own[: len(own) // 2] = [f"f{i % 4}x{j}" for j in range(len(own) // 2)]
        texts.append((i, " ".join(own + template[rng.randint(0, 3) : 90 - rng.randint(0, 3)])))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    root = groups([shingles(t) for _, t in texts], jaccard)
    low = {}
    for (i, _), g in zip(texts, root, strict=True):
        low.setdefault(g, i)
    assert got == {i: low[g] for (i, _), g in zip(texts, root, strict=True)}
    assert 1 < len(set(got.values())) < 150


def test_crossing_gives_each_fitting_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), r, rng.randint(20, 60), rng.randint(0, 8), rng.randint(0, 5)) for r in range(120)]
    df = spark.createDataFrame(rows, "token long, rep long, n long, pos long, comp long").selectExpr("*", f"cast(floor(ln(n) / ln({ngram_join.CLASS})) as int) AS class")

    def fits(na, pa, nb, pb):
        a, b = F.col(na), F.col(nb)
        return (a * 4 <= b * 5) & (b * 4 <= a * 5) & (F.least(a - F.col(pa), b - F.col(pb)) >= F.ceil((a + b) * 4 / 9 - 1e-9))

    got = [tuple(sorted(r)) for r in ngram_join._crossing(df, Scratch(spark, "t"), fits, 4, 5).collect()]
    want = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[4] != b[4] and a[2] * 4 <= b[2] * 5 and b[2] * 4 <= a[2] * 5 and min(a[2] - a[3], b[2] - b[3]) >= -(-4 * (a[2] + b[2]) // 9)]
    assert sorted(got) == sorted(want) and want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (200, 205), (205, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200: 200, 201: 200, 205: 200}


def test_components_that_are_not_done_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(edges, Scratch(spark, "t"), max_rounds=1).collect()


def test_line_dedup(docs, rows):
    every = [list(r) for r in rows]
    line = "This is a rather long line of text that has enough characters in it to be compared, and then some more of it."
    every += [[900 + k, f"{line[:50]}{k}{line[51:]}\n\nown line {k * 7919}", "en", "s", 0] for k in range(5)]
    frame = docs.sparkSession.createDataFrame([tuple(r) for r in every], docs.schema)
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept"] or "") for r in line_dedup.drop_repeated_lines(frame).collect())
    ws = " \t\n\x0b\x0c\r"
    lines = [(r[0], k, x.strip(ws)) for r in every for k, x in enumerate((r[1] or "").split("\n")) if x.strip(ws)]
    distinct = list(dict.fromkeys(x for _, _, x in lines))
    gram = lambda b: frozenset(b[i : i + 5] for i in range(len(b) - 4)) if len(b) >= 5 else frozenset([b])
    sets = [gram(x) for x in distinct]
    root = dict(zip(distinct, groups(sets, lambda a, b: jaccard(a, b)), strict=True))
    first = {}
    for d, k, x in sorted(lines):
        first.setdefault(root[x], (d, k))
    want = []
    for r in every:
        parts = (r[1] or "").split("\n")
        gone = {k for d, k, x in lines if d == r[0] and first[root[x]] != (d, k)} if r[1] else set()
        want.append((r[0], len(parts) if r[1] else 0, len(gone), "\n".join(p for k, p in enumerate(parts) if k not in gone)))
    assert got == sorted(want)


def test_lines_that_share_a_passage_and_large_buckets(spark, monkeypatch):
    """Many lines of one bucket: the blocks' size decides nothing, and every link is found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = " ".join(word() for _ in range(40))
    family = [word() for _ in range(40)]
    lines = [passage + " " + " ".join(word() for _ in range(12)) for _ in range(150)]
    for _ in range(60):
        words = list(family)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(40)] = word()
        lines.append(passage[:80] + " ".join(words))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(6)
    gram = lambda b: frozenset(b[i : i + 5] for i in range(len(b) - 4))
    root = groups([gram(x) for x in lines], jaccard)
    want = len(lines) - len(set(root))
    assert want > 50
    for size in (8, 4096):
        monkeypatch.setattr(line_dedup, "BLOCK", size)
        got = [r["doc_id"] for r in line_dedup.drop_repeated_lines(frame).where("n_removed > 0").collect()]
        first = {g: i for i, g in reversed(list(enumerate(root)))}
        assert len(got) == want and not set(got) & set(first.values())


def test_clashing_columns_change_nothing(docs, clashing):
    for f in (suffix_dedup.remove_repeats, line_dedup.drop_repeated_lines):
        assert sorted(map(str, f(clashing).collect())) == sorted(map(str, f(docs).collect()))


def test_line_dedup_of_nothing(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_shingle_comparison_is_exact_in_any_alphabet():
    """Numbers of 12 bits a character, and sets where characters are too many, give the links of plain sets."""
    rng = random.Random(4)
    kinds = ("abcdef", "aéß日本語😀", [chr(c) for c in range(0x4E00, 0x4E00 + 9000)])
    for letters in kinds:
        lines = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 400))) for _ in range(40)]
        lines += [x[: len(x) // 2] + rng.choice(letters) + x[len(x) // 2 + 1 :] for x in lines] + [x + x for x in lines]
        sets = line_dedup.shingle_sets(lines)
        plain = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
        assert [len(x) for x in sets] == [len(x) for x in plain]
        pairs = [(i, j) for i in range(120) for j in range(i)]
        assert [line_dedup.similar(sets[i], sets[j], 4, 5) for i, j in pairs] == [jaccard(plain[i], plain[j]) for i, j in pairs]


def test_exact_comparisons_need_no_strings():
    """The cost of op5: a pair's shingles are numbers, and a signature takes 32-bit hashes (before, sets of strings and 64 bits)."""
    assert all(isinstance(x, np.ndarray) for x in line_dedup.shingle_sets(["Größe und Maß der Zeile", "ещё одна строка", "and one more"]))
    assert line_dedup.signatures(["a line of text", "another line of text"]).dtype == np.uint32


def test_similar_lines_share_a_band():
    """Of pairs of similarity 0.80 to 0.83 at most 1 in 100 shares no band, and all agree in enough slots."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    a, b = [], []
    while len(a) < 1500:
        words = [word() for _ in range(rng.choice((12, 30, 80, 250)))]
        other = list(words)
        for k in rng.sample(range(len(words)), max(1, len(words) // rng.randint(10, 25))):
            other[k] = word()
        x, y = " ".join(words), " ".join(other)
        one, two = line_dedup.grams(x), line_dedup.grams(y)
        if 0.8 <= len(one & two) / len(one | two) <= 0.83:
            a.append(x)
            b.append(y)
    (low_a, bands_a), (low_b, bands_b) = line_dedup.sketches(a), line_dedup.sketches(b)
    assert (bands_a == bands_b).any(1).mean() > 0.99
    assert (low_a == low_b).mean(1).min() >= line_dedup.PLAUSIBLE


def test_lines_joined_by_a_chain_of_buckets(spark):
    """A line that links two families which centres leave apart, copies of all of them, and the first line stays."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    lines = []
    for k in range(24):
        words[(k * 7) % 60] = "".join(rng.choice("klmnopqrst") for _ in range(6))
        lines.append(" ".join(words))
    gram = lambda b: frozenset(b[i : i + 5] for i in range(len(b) - 4))
    root = groups([gram(x) for x in lines], jaccard)
    docs = [(i, lines[i % 24]) for i in range(48)] + [(5, lines[5])]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    first = {g: i for i, g in reversed(list(enumerate(root)))}
    assert got == {i: int(i not in first.values()) for i in range(48)}
