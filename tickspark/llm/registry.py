"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tickspark.llm import collocations, conversation_repair, decontaminate, language_id, line_dedup, mixing, ngram_join, pii, quality, sharding, suffix_dedup, token_counts, warc

MODULES = (mixing, suffix_dedup, language_id, decontaminate, line_dedup, pii, token_counts, quality, ngram_join, sharding, warc, collocations, conversation_repair)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
