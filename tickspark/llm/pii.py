"""Personal data: exact base rules, and a character BiLSTM-CRF that adds spans.

The model is a bidirectional LSTM over character classes with CRF transitions,
trained in numpy from labelled spans: stretches of a bounded sample of documents
labelled by the base rules, and the same stretches with synthetic items in the
looser forms people write.  Texts are read whole.  A span must hold a digit or
an at-sign (the last test before it counts asks for one), so stretches around
these are all that can hold one.  They are tiled by overlapping windows, so that a
span of up to 48 characters is whole in one of them; each window is decoded by Viterbi with posterior
confidences, and the spans of all windows of a text are reconciled together:
the more confident first, then the longer, none overlapping another or a base span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import read_table, sub_batches

KINDS = ("email", "ip", "card", "phone")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

WINDOW, STRIDE, MARGIN = 96, 24, 24
#: A trigger gets the windows in which it stands neither here nor as near to the end.
EDGE = 12
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
CLASSES = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _fine(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, leftmost and non-overlapping per kind, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if _fine(KINDS[k], m[0])]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---- characters -----------------------------------------------------------

_CODE = np.full(65536, 2, np.uint8)  # other letters and signs
for _i, _c in enumerate("@.-+() \n_%:/,\"=#'"):
    _CODE[ord(_c)] = 6 + _i
_CODE[0] = 0  # padding
_CODE[48:58] = 1
_CODE[65:91] = 3
_CODE[97:123] = 4
for _c in "!$&*;<>?[\\]^`{|}~":
    _CODE[ord(_c)] = 5
_CODE[9] = _CODE[ord(" ")]


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(raw, 65535)]


# ---- model ----------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """BiLSTM-CRF.  Shapes: B windows, T characters, D embedding, H units a direction, K tags."""

    def __init__(self, dim: int = 8, units: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.units = units
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"emb": w(CLASSES, dim), "out": w(2 * units, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": w(dim, 4 * units), f"u{d}": w(units, 4 * units), f"b{d}": np.zeros(4 * units, np.float32)}
            self.p[f"b{d}"][units : 2 * units] = 1
        # A further character follows the first or another one of its kind only.
        self.allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.allowed[:, inside] = False
            self.allowed[[inside - 1, inside], inside] = True
        self.start = np.array([0.0] + [0.0, -1e4] * len(KINDS), np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x (T, B, D) in reading order of the direction; hidden states (T, B, H)."""
        p, n = self.p, self.units
        zx = x @ p[f"w{d}"] + p[f"b{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        hs, tape = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(x.shape[0]):
            z = zx[t] + h @ p[f"u{d}"]
            i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((i, f, o, g, c, tc, h))
            h, c = o * tc, c_new
            hs[t] = h
        return hs, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x (B, T) character codes; scores (T, B, K)."""
        e = self.p["emb"][x.T]
        hf, tf = self._lstm(e, "f", keep)
        hb, tb = self._lstm(e[::-1], "b", keep)
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ self.p["out"] + self.p["out_b"], (e, h, tf, tb)

    def _trans(self) -> np.ndarray:
        return np.where(self.allowed, self.p["trans"], np.float32(-1e4))

    def posterior(self, em: np.ndarray):
        """Forward-backward: log partition (B,), log alpha, log beta (T, B, K)."""
        tr, steps = self._trans(), em.shape[0]
        a, b = np.empty_like(em), np.zeros_like(em)

        def lse(s: np.ndarray, axis: int) -> np.ndarray:
            m = s.max(axis, keepdims=True)
            return (m + np.log(np.exp(s - m).sum(axis, keepdims=True))).squeeze(axis)

        a[0] = em[0] + self.start
        for t in range(1, steps):
            a[t] = lse(a[t - 1][:, :, None] + tr[None], 1) + em[t]
        for t in range(steps - 2, -1, -1):
            b[t] = lse(tr[None] + (em[t + 1] + b[t + 1])[:, None, :], 2)
        return lse(a[-1], 1), a, b

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        tr, steps = self._trans(), em.shape[0]
        back = np.empty(em.shape, np.int8)
        s = em[0] + self.start
        for t in range(1, steps):
            every = s[:, :, None] + tr[None]
            back[t] = every.argmax(1)
            s = np.take_along_axis(every, back[t][:, None, :].astype(np.int64), 1)[:, 0] + em[t]
        path = np.empty(em.shape[:2], np.int8)
        path[-1] = s.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
        return path

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y (B, T) and the gradients of all parameters."""
        em, (e, h, tf, tb) = self.emissions(x, True)
        steps, size, _ = em.shape
        z, a, b = self.posterior(em)
        tr, yt = self._trans(), y.T
        row = np.arange(size)
        gold = em[0, row, yt[0]] + self.start[yt[0]]
        for t in range(1, steps):
            gold = gold + em[t, row, yt[t]] + tr[yt[t - 1], yt[t]]
        d_em = np.exp(a + b - z[None, :, None])
        d_tr = np.zeros_like(tr)
        for t in range(1, steps):
            d_tr += np.exp(a[t - 1][:, :, None] + tr[None] + (em[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(d_tr, (yt[t - 1], yt[t]), -1)
        for t in range(steps):
            d_em[t, row, yt[t]] -= 1
        d_em /= size
        g = {"trans": np.where(self.allowed, d_tr / size, 0).astype(np.float32)}
        flat = d_em.reshape(-1, TAGS)
        g["out"], g["out_b"] = h.reshape(-1, h.shape[2]).T @ flat, flat.sum(0)
        d_h = d_em @ self.p["out"].T
        n = self.units
        d_e = np.zeros_like(e)
        for d, tape, dh_all, rows in (("f", tf, d_h[:, :, :n], e), ("b", tb, d_h[::-1, :, n:], e[::-1])):
            u = self.p[f"u{d}"]
            dz_all = np.empty((steps, size, 4 * n), np.float32)
            dh_next = dc = np.zeros((size, n), np.float32)
            gu = np.zeros_like(u)
            for t in range(steps - 1, -1, -1):
                i, f, o, gg, c_old, tc, h_old = tape[t]
                dh = dh_all[t] + dh_next
                dc = dc + dh * o * (1 - tc * tc)
                dz = dz_all[t]
                dz[:, :n] = dc * gg * i * (1 - i)
                dz[:, n : 2 * n] = dc * c_old * f * (1 - f)
                dz[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
                dz[:, 3 * n :] = dc * i * (1 - gg * gg)
                gu += h_old.T @ dz
                dh_next, dc = dz @ u.T, dc * f
            flat_z = dz_all.reshape(-1, 4 * n)
            g[f"w{d}"], g[f"b{d}"], g[f"u{d}"] = rows.reshape(-1, rows.shape[2]).T @ flat_z, flat_z.sum(0), gu
            back = dz_all @ self.p[f"w{d}"].T
            d_e += back if d == "f" else back[::-1]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], x.T, d_e)
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.015, seed: int = 9) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                loss, g = self.loss_and_grads(x[at], y[at])
                norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                lr = rate * (1 - step / total)
                step += 1
                for k, q in g.items():
                    q = q * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v2[k] = 0.99 * v2[k] + 0.01 * q * q
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


# ---- labelled stretches ---------------------------------------------------


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for a, k, b in spans:
        a, b = max(a, 0), min(b, n)
        if a < b and not y[a:b].any():
            y[a] = 1 + 2 * k
            y[a + 1 : b] = 2 + 2 * k
    return y


def _synthetic(rng: np.random.Generator) -> tuple[str, int | None]:
    """An item in a form that the base rules may miss, with its kind, or a harmless look-alike with None."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    form = int(rng.integers(0, 14))
    if form == 0:
        return f"({num(3)}) {num(3)}-{num(4)}", 3
    if form == 1:
        return f"{num(3)}-{num(3)}-{num(4)}", 3
    if form == 2:
        return f"{num(3)}.{num(3)}.{num(4)}", 3
    if form == 3:
        return f"00{rng.integers(1, 99)} {num(3)} {num(3)} {num(4)}", 3
    if form == 4:
        return f"+{rng.integers(1, 99)} ({num(3)}) {num(3)}-{num(4)}", 3
    if form == 5:
        return f"{word()}.{num(2)} @ {word()}.{word()[:3]}", 0
    if form == 6:
        return f"{word()}{num(2)}@{word()}.example.com", 0
    if form == 7:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), 1
    if form == 8:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = ("", " ", "-", ".")[rng.integers(0, 4)]
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)), 2
    if form == 9:
        return f'token = "{"".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 40))}"', None
    if form == 10:
        return f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}.", None
    if form == 11:
        return f"{rng.integers(1900, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", None
    if form == 12:
        return num(int(rng.integers(1, 7))), None
    return f"{num(2)},{num(3)}.{num(2)}", None


def training_windows(texts: list[str], synthetic: int = 1200, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: around every trigger of texts, and with a synthetic item put into a stretch without one."""
    rng = np.random.default_rng(seed)
    xs, ys, plain = [], [], []
    for text in texts:
        spans, code = base_spans(text), None
        done = -1
        for m in _TRIGGER.finditer(text):
            if m.start() < done:
                continue
            a = max(0, m.start() - int(rng.integers(MARGIN, WINDOW - MARGIN)))
            done = a + WINDOW
            code = codes(text) if code is None else code
            xs.append(np.pad(code[a : a + WINDOW], (0, max(0, a + WINDOW - code.size))))
            ys.append(_tags(WINDOW, [(s - a, k, e - a) for s, k, e in spans if s >= a and e <= a + WINDOW]))
        for a in rng.integers(0, max(1, len(text) - WINDOW), 4):
            piece = text[a : a + WINDOW]
            if not _TRIGGER.search(piece):
                plain.append(piece)
    plain = plain or ["and so the words of a line go on. They end\nhere, or there, as they like it best of all in the end "]
    for _ in range(synthetic):
        host = plain[rng.integers(0, len(plain))]
        item, kind = _synthetic(rng)
        cut = int(rng.integers(0, max(1, WINDOW - len(item))))
        left = host[:cut]
        cut = len(left)
        gap = "" if rng.random() < 0.1 or not cut else " "
        text = (left + gap + item + " " + host[cut:])[:WINDOW].ljust(WINDOW, "\0")
        a = cut + len(gap)
        xs.append(codes(text))
        ys.append(_tags(WINDOW, [] if kind is None or a + len(item) > WINDOW else [(a, kind, a + len(item))]))
    return np.stack(xs), np.stack(ys)


# ---- spans ----------------------------------------------------------------


def _windows(text: str) -> list[int]:
    """Starts, multiples of STRIDE, of the windows around triggers: any 48 characters with one lie within such a window."""
    out, after = [], 0
    for m in _TRIGGER.finditer(text):
        first = max(0, -(-(m.start() - WINDOW + EDGE) // STRIDE), after)
        after = max(after, max(0, (m.start() - EDGE) // STRIDE) + 1)
        out += range(first, after)
    return [STRIDE * k for k in out]


def _plausible(kind: int, s: str) -> bool:
    d = _digits(s)
    if kind == 0:
        left, _, right = s.partition("@")
        return bool(left.strip()) and "." in right and len(s) <= 80
    if kind == 1:
        return len(s.split(".")) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], confidence: float = 0.9, batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans that the model adds to the base spans of each text."""
    at = [(i, a) for i, t in enumerate(texts) for a in _windows(t)]
    code: dict[int, np.ndarray] = {}
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for j in range(0, len(at), batch):
        part = at[j : j + batch]
        x = np.zeros((len(part), WINDOW), np.uint8)
        for r, (i, a) in enumerate(part):
            if i not in code:
                code = {i: codes(texts[i])}
            piece = code[i][a : a + WINDOW]
            x[r, : piece.size] = piece
        em, _ = model.emissions(x)
        path = model.viterbi(em).T
        if not path.any():
            continue
        z, al, be = model.posterior(em)
        sure = np.exp(np.take_along_axis(al + be - z[None, :, None], path.T[:, :, None].astype(np.int64), 2)[:, :, 0]).T
        for r in np.flatnonzero(path.any(1)):
            i, a = part[r]
            tags = path[r]
            for s in np.flatnonzero(tags % 2 == 1):
                e = s + 1
                while e < WINDOW and tags[e] == tags[s] + 1:
                    e += 1
                cut = (s == 0 and a > 0) or (e == WINDOW and a + WINDOW < len(texts[i]))
                if not cut:  # a neighbouring window has the whole of it
                    found[i].append((float(sure[r, s:e].mean()), a + int(s), int(tags[s] - 1) // 2, a + int(e)))
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        taken = [(a, b) for a, _, b in own]
        new = []
        for score, a, k, b in sorted(set(spans), key=lambda s: (-s[0], s[1] - s[3], s[1], s[2])):
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if score >= confidence and a < b and _plausible(k, text[a:b]) and all(b <= p or a >= q for p, q in taken):
                taken.append((a, b))
                new.append((a, k, b))
        out.append(new)
    return out


def fit(docs: DataFrame, sample: int = 300) -> Tagger:
    """Train on at most ``sample`` documents with a digit or at-sign, those whose hash of doc_id and text is smallest.

    Their number is counted first and the hash bounded by it, and equal rows
    count once, so that little more than the sample reaches the driver, however
    many tasks there are and whatever ids are null or repeated.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    n = rows.count()
    bound = int((1 << 63) * min(1.0, 1.3 * sample / max(n, 1))) - 1
    found = sorted((r["h"], str(r["doc_id"]), r["text"]) for r in rows.where(F.col("h") <= bound).distinct().collect())
    x, y = training_windows([text for _, _, text in found[:sample]])
    model = Tagger()
    model.fit(x, y)
    return model


def find_pii(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, counts and hash of the base spans, and all spans of every row.

    Null counts as empty, and an empty text has no spans; further columns aren't
    read; repeated rows are searched each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for batch in sub_batches(batches, 4_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(shared.value, texts, base)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
            spans = pa.array([joined(b + n) for b, n in zip(base, added, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, spans, pa.array([len(n) for n in added], pa.int64())], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and hash, and all spans, of every row.

    Null counts as empty.  Base spans of one start go by kind; of overlapping
    spans that the model adds the surest stays, then the longest, then the first.
    The model sees windows around each digit and at-sign, as a span without either
    is none.  Repeated rows get equal results.  A text is searched in one task,
    with about 60 bytes of memory for each of the longest text.  An empty table
    gives an empty result.
    """
    docs = read_table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
