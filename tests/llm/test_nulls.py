"""Nulls in any column, and two rows of one doc_id with different texts."""

import pytest

from tickspark.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, pii, quality, sharding, suffix_dedup, token_counts

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, TEXT, "en", "a", None), (None, None, None, None, None), (1, TEXT, None, "a", 1), (2, TEXT + " phi", "en", None, 2), (2, "other words", "de", None, None), (3, "", None, "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_nulls(spark, odd):
    import public_tokenizers

    n = odd.count()
    bench = spark.createDataFrame([(None, TEXT), (1, None)], "item_id long, text string")
    assert mixing.mix_table(odd).count() == n
    assert mixing.mix_table(odd).where("target is null").count() == 0
    assert sharding.shard_table(odd, 4).count() == n
    assert suffix_dedup.remove_repeats(odd, 40).count() == n
    assert language_id.identify(odd, language_id.fit(odd)).count() == n
    assert pii.find_pii(odd, pii.Tagger()).count() == n
    assert token_counts.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json")).count() == n
    assert quality.ledger(odd).count() == n
    lines = {(r["doc_id"], r["n_removed"]) for r in line_dedup.drop_repeated_lines(odd).collect()}
    assert len([x for x in lines if x[1] == 1]) >= 1
    join = ngram_join.similarity_classes(odd).collect()
    assert len(join) == n
    assert {r["component_id"] for r in join if r["n_shingles"] > 10} == {1}
    assert ngram_join.keep_one_of_each(odd).count() >= 3
    assert decontaminate.contaminated(odd, bench).count() == 3
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.where(f"text = '{TEXT}'").count() == 0
