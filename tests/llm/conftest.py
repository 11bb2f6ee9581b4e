import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were".split()
DE = "der die und den das von ist mit sich auf nicht ein eine als auch wird werden sind haben wurde durch nach noch beim kann über".split()


def prose(rng, words, n):
    out = []
    for i in range(n):
        w = rng.choice(words) + rng.choice(words)
        out.append(w + rng.choice([" ", " ", " ", ", ", ".\n"]))
    return "".join(out).strip()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, words = ("en", EN) if i % 3 else ("de", DE)
        rows.append([i, prose(rng, words, rng.randint(30, 160)), lang, "s0" if i % 3 else f"s{i % 5}"])
    rows[10][1] = rows[4][1]
    rows[11][1] = rows[4][1]
    rows[12][1] = rows[5][1] + " one more word"
    rows[13][1] = rows[5][1].replace(" ", "  ", 3)
    rows[14][1] = rows[6][1] + "\n" + rows[7][1]
    rows[15][1] = rows[8][1].replace(rows[8][1].split()[20], "changed", 1)
    rows[20][1] = None
    rows[21][1] = ""
    rows[22][1] = " \n\t "
    rows[23][1] = "one two"
    rows[24][1] = "one two"
    rows[25][1] = "12 34 !!"
    rows[26][1] = "long " * 9000 + rows[9][1]
    rows[27][2] = None
    rows[28][3] = None
    rows[29][1] = "ÄÖÜ über straße — “quoted” 日本語 \x85 x\x1cy"
    rows[31][1] = "a\n" * 5 + rows[30][1] + "\n" + rows[30][1].split("\n")[0]
    rows[32][1] = "<|endoftext|> it's 'll 123,456.78   trailing  "
    rows[33] = list(rows[34])  # a repeated row
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("key", "row", "size", "rep", "g", "shard", "slot", "lang_pred", "_g", "bucket", "words", "score", "accepted", "_held", "uid", "node", "n", "k1", "digest"):
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def tagger(docs):
    from tickspark.llm import pii

    return pii.fit(docs)


@pytest.fixture(scope="session")
def languages(docs):
    from tickspark.llm import language_id

    return language_id.fit(docs)
