"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed subwords (runs of 2 to 4
bytes inside words, word borders marked), put through a linear softmax.  Both
layers are trained in numpy by stochastic gradient descent on a bounded,
stratified sample of labelled rows.  A held-out fifth of that sample calibrates:
a temperature makes the scores probabilities, and the rejection threshold is the
lowest score above which at most ``max_error`` of the held-out texts are wrong,
but never above MAX_THRESHOLD: a rejected document is lost for good, so texts in
which two languages are mixed stay.

Prediction is map-side.  As the model is linear in the average, embeddings and
softmax weights fold into one score per subword and language, so that a text
costs one table look-up per subword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.llm.common import read_table, sub_batches

BITS, ORDERS, DIM = 16, (2, 3, 4), 16
UNKNOWN = "und"
MAX_THRESHOLD = 0.4

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SPACE = np.uint8(32)
_WORD = re.compile(r"\S+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def subwords(texts: list[str]):
    """Yield (bucket of each position, mask of valid positions) per order; and the start of each text last.

    All texts are laid out in one buffer with blanks between them.
    """
    parts = [b" " + t.lower().encode("utf-8", "replace") + b"    " for t in texts]
    raw = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    letter = raw != _SPACE
    h = raw.astype(np.uint32)
    inner = letter
    out = []
    for n in range(2, max(ORDERS) + 1):
        last = raw.size - n + 1
        h = h[:last] * np.uint32(0x01000193) ^ raw[n - 1 :].astype(np.uint32)
        # valid: letters inside, a blank at most at either end, not two blanks
        ok = (letter[:last] | letter[1 : last + 1]) if n == 2 else inner[1 : last + 1]
        if n in ORDERS:
            mixed = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), ok))
        inner = letter[: raw.size - n + 2] if n == 2 else inner[: raw.size - n + 2] & letter[n - 2 : n - 2 + raw.size - n + 2]
    return out, starts


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages): score of each subword
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities (texts, languages)."""
        grams, starts = subwords(texts)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for at, ok in grams:
            at, cut = at[ok], np.searchsorted(np.flatnonzero(ok), starts)
            ends = np.append(cut[1:], at.size)
            for c in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(self.table[:, c][at], dtype=np.float64)])
                total[:, c] += run[ends] - run[cut]
            count += ends - cut
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and calibrated score; ``und`` and 0 for null, texts without letters, and models without languages."""
        live = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if live:
            p = self.scores([texts[i] for i in live])
            for i, k, s in zip(live, p.argmax(1), p.max(1), strict=True):
                lang[i], score[i] = self.langs[k], float(min(1.0, s))
        return lang, score


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        grams, _ = subwords([t])
        at, n = np.unique(np.concatenate([a[ok] for a, ok in grams]), return_counts=True)
        out.append((at, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[str, str]], seed: int = 5, steps: int = 18_000, rate: float = 0.4, max_error: float = 0.005) -> Model:
    """Fit on (text, language) pairs; pieces of 4 to 40 words join the whole texts, so that short texts are known too.

    steps is the least number of gradient steps; a small sample is gone through more often.
    """
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    if len(langs) < 2:
        return Model(langs, np.zeros((1 << BITS, len(langs)), np.float32), np.zeros(len(langs)), 1.0, 0.0)
    texts, labels, held = [], [], []
    for i, (text, lang) in enumerate(rows):
        words = _WORD.findall(text)
        for piece in range(3):
            if piece and len(words) > 4:
                n = int(rng.integers(4, 41))
                a = int(rng.integers(0, max(1, len(words) - n)))
                texts.append(" ".join(words[a : a + n]))
            elif piece:
                continue
            else:
                texts.append(text)
            labels.append(langs.index(lang))
            held.append(i % 5 == 4)
    features, labels, held = _features(texts), np.array(labels), np.array(held)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    fit = np.flatnonzero(~held)
    epochs = max(4, -(-steps // max(1, fit.size)))
    step, steps = 0, epochs * fit.size
    for _ in range(epochs):
        for i in rng.permutation(fit):
            lr, (at, f) = rate * (1 - step / steps), features[i]
            rows_ = emb[at]
            h = f @ rows_
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            b -= lr * 0.1 * p
            # A subword's step is not divided by the text's length twice: rare subwords would hardly move.
            emb[at] = rows_ - (lr * np.sqrt(at.size)) * np.outer(f, back)
            step += 1
    model = Model(langs, (emb @ w).astype(np.float32), b.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held)
    if check.size:
        z = np.log(np.maximum(model.scores([texts[i] for i in check]), 1e-300))
        y = labels[check]

        def loss(t: float) -> float:
            q = z / t
            q = q - q.max(1, keepdims=True)
            return float((np.log(np.exp(q).sum(1)) - q[np.arange(y.size), y]).mean())

        model.temperature = min(np.geomspace(0.02, 5, 60), key=loss)
        p = model.scores([texts[i] for i in check])
        order = np.argsort(-p.max(1), kind="stable")
        wrong = np.cumsum(p.argmax(1)[order] != y[order])
        fine = np.flatnonzero(wrong <= max_error * np.arange(1, y.size + 1))
        if not fine.size or fine[-1] < y.size - 1:
            model.threshold = min(MAX_THRESHOLD, float(p.max(1)[order[fine[-1]]]) if fine.size else 1.0)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row is of the third that no model learns from; rows without id aren't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, per_lang: int, seed: int = 11, max_langs: int = 200) -> list[tuple[str, str]]:
    """At most per_lang (text, language) rows of each language outside the held-out third, the same on every run.

    Only the max_langs languages of most rows are learned, ties by name.  Rows
    are drawn by a hash of doc_id and text, and equal rows count once, so that no
    more than about per_lang texts a language reach the driver, whatever ids repeat.
    """
    rows = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not counts:
        return []
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / F.lit(float(1 << 53))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (u < min(1.0, 1.2 * per_lang / n)))
    found = sorted((r["u"], str(r["doc_id"]), r["lang"], r["text"]) for r in rows.where(keep).select(u.alias("u"), "doc_id", "lang", "text").distinct().collect())
    out, n = [], dict.fromkeys(counts, 0)
    for _, _, lang, text in found:
        if n[lang] < per_lang and has_letter(text):
            n[lang] += 1
            out.append((text, lang))
    return out


def fit(docs: DataFrame, per_lang: int = 300) -> Model:
    return train(labelled_sample(docs, per_lang))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and accepted; columns of these names are replaced.

    Null texts and texts without letters are ``und`` with score 0 and not
    accepted; others are accepted from the model's threshold on.
    """
    keep = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in sub_batches(batches, 2_000_000):
            lang, score = m.predict(batch.column("text").to_pylist())
            accepted = [x != UNKNOWN and s >= m.threshold for x, s in zip(lang, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "accepted"])

    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return keep.mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, with the columns they came with, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in sub_batches(batches, 2_000_000):
            lang, score = m.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= m.threshold for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every row.

    Null texts and texts without letters are ``und``; of languages of equal
    score the first by name wins; repeated rows get equal results.  A text is
    scored piece by piece in one task, with about 30 bytes of memory for each of
    the longest text.  An empty table gives an empty result.
    """
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
