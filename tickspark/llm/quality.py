"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps each document's
measurements and one bit per failed rule.  A policy is a version, a mask of
rules that reject and nothing else, so policies are applied, compared and
ablated on the ledger by bit operations, without reading a text again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import mix64, pair64, read_table, sub_batches

SYMBOLS = re.compile(rb"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_alpha")

#: (name, failing condition over the measurements).  The position is the bit; rules are only ever appended.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_noise", "10 * n_symbols > n_words"),
    ("exclamation_noise", "10 * n_bangs > n_words"),
    ("mostly_upper_case", "n_alpha >= 20 and 2 * n_upper > n_alpha"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("overlong_words", "n_words > 0 and word_chars > 12 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
PRODUCTION = Policy("2", tuple(BIT))


def _repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n <= window:
        return 0
    h = mix64(np.fromiter(map(hash, words), np.int64, n).view(np.uint64))
    size = 1
    while size < window:
        h = pair64(h[:-size], h[size:])
        size *= 2
    order = np.sort(h)
    again = order[1:][order[1:] == order[:-1]]
    if not again.size:
        return 0
    again = np.unique(again)
    at = np.searchsorted(again, h)
    at[at == again.size] = 0
    starts = np.flatnonzero(again[at] == h)
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(change[:n])))


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text in the order of MEASURES; null has no words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # for bytes, exactly blank, tab, line feed, VT, FF, CR
    raw = np.frombuffer(data, np.uint8)
    spaces = np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = np.count_nonzero(_UPPER[raw])
    return (
        len(words),
        int(np.count_nonzero((raw & 0xC0) != 0x80) - spaces),
        len(SYMBOLS.findall(data)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        data.count(b"!"),
        int(upper),
        int(np.count_nonzero(_ALPHA[raw])),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed (long): bit i set where rule i fails.

    Null and empty texts have no words and fail only the rules that say so;
    repeated rows are measured each; further columns aren't read.
    """

    def run(batches):
        import pyarrow as pa

        for batch in sub_batches(batches, 8_000_000):
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    kind = dict(docs.dtypes)["doc_id"]
    measured = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0).cast("long"))
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: how many documents fail it, how many fail it alone, and what the policy keeps without it."""
    on = F.col("failed").bitwiseAND(F.lit(policy.mask))
    patterns = rows.groupBy(on.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    bits, n, bit = F.col("bits"), F.col("n"), F.col("r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return patterns.select("bits", "n", rule).groupBy(F.col("r.rule").alias("rule")).agg(
        total(bits.bitwiseAND(bit) != 0).alias("n_failed"), total(bits == bit).alias("n_failed_alone"), total((bits == 0) | (bits == bit)).alias("n_kept_without")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every row.

    Null, empty and blank texts have zeros everywhere and fail for having few
    words; repeated rows are measured each, and nothing depends on their order.  A
    text is measured whole in one task.  An empty table gives an empty result.
    """
    rows = ledger(read_table(spark, sf_dir, "documents"))
    rows = apply_policy(apply_policy(rows, PRODUCTION), BASE, "base_kept")
    return rows.select("doc_id", *MEASURES[:5], (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


_CONDITIONS = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES))
_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) > 7),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM k),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_alpha
  FROM t LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({_CONDITIONS} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE.mask}) <> 0 AS base_failed, (failed & {PRODUCTION.mask}) = 0 AS kept, failed FROM f"""

QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {"op8_quality": _SQL}
