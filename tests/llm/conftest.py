import random

import pytest

#: Column names that operators use themselves, as further columns of the input.
CLASHING = ("id", "digest", "check", "size", "node", "n", "fp", "kept", "keep_id", "grp", "bucket", "score", "label", "place", "spans", "host", "rule", "text_hash", "weight", "shard", "__score", "__host", "__path", "__c", "__items", "__spans", "__n_words", "__digest", "__id", "__hash", "__at", "items", "spans", "n_words", "_spans", "ident", "own_host", "own_path", "own_score", "of_grams")


def odd_texts() -> list:
    rng = random.Random(5)
    words = ["the", "of", "Idiot", "é", "中文", "a1", "x-y", "foo", "bar", "baz", "qux", "ni", "ki"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = body(60)
    long = body(30_000)
    return [None, "", " ", "\n\t", "one", "a b c", body(40), shared, shared, shared + " tail one", "head two " + shared, body(400), long, long, "z" * 200_000, "Ä" * 3 + "\x00 \x1c <|endoftext|> don't", body(35), "é é é é é é", "same same same same", "same same same same"]


@pytest.fixture(scope="session")
def odd_rows():
    rows = list(enumerate(odd_texts()))
    rows += [(None, "no id"), (None, None), (None, "one"), rows[4], rows[7], (-5, "one"), (2**62, "a b c")]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
