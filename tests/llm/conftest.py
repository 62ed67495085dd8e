import os

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="session")
def bpe_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def document_rows(extra=()):
    """Documents with nulls in every column, empty and very long texts, ties, repeats."""
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "de", "b", 4),
        (5, long, "en", "b", len(long)),
        (6, "one two three", "en", "a", 13),
        (7, "ONE two\nthree", "en", None, 13),
        (8, "the quick brown fox jumps over the lazy dog again and again today", "fr", "c", 1),
        (8, "the quick brown fox jumps over the lazy dog again and again today", "fr", "c", 1),
        (None, "a row without an id has eleven words of its own here", None, "c", 3),
        *extra,
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(document_rows(), SCHEMA)
    clash = ("n_words", "score", "group", "token", "size", "key", "ids", "kept", "n", "y", "word", "block", "t", "b")
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
