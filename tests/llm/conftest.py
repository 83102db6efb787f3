import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, id bigint, n bigint, key string, shard int, text_hash bigint, digest string, found string, __id bigint, file string, ids string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def prose(seed: int, words: int = 120, pool: int = 400) -> str:
    r = random.Random(seed)
    out = [r.choice(["the", "of", "and", "to", "in", "is"]) if r.random() < 0.4 else f"w{r.randrange(pool)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(words)]
    return " ".join(out)


def table(spark, texts):
    """documents of (doc_id, text[, lang]), with extra columns whose names clash with those inside the operators."""
    rows = [(*t[:2], t[2] if len(t) > 2 else "en") for t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    df = df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    for x in SCHEMA.split(", ")[5:]:
        name, kind = x.split()
        df = df.withColumn(name, F.lit(None if name == "row" else 7).cast(kind))
    return df


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd white space."""
    near = prose(5, 200)
    texts = [
        (1, prose(1)), (2, prose(1)), (2, prose(1)), (3, None), (None, prose(3)), (None, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one"), (8, "Ünïcode  ß\u00a0\u3000x\x1cy é é 'S don't 12 345\n\nend"), (9, near), (10, near + " extra words"), (11, "x" * 200_000), (12, prose(12, 20_000)),
        (13, "token = \"" + "0123456789abcdef" * 2 + "01234567\" mail a.b@c.example.org card 4111 1111 1111 1111 at 10.0.0.1 +1 (555) 123-4567.", None), (14, "a\na\na\n" + "again " * 60, "xx"), (15, "Released under the MIT License.\nother"), (16, "<|endoftext|> and  <|startoftext|>x"),
    ]
    return table(spark, texts)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [(1, "x")]).limit(0)
