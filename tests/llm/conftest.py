import random

import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "de", None, 0), (3, "   \n\t ", None, "a", 1), (4, LONG, "en", "a", 5), (5, "same text of five words here", "en", "b", 1), (6, "same text of five words here", "en", "b", 1),
        (6, "same text of five words here", "en", "b", 1), (None, "no id at all in this row", "en", "b", 1), (7, "one two", "fr", "b", 1), (8, "12345 !!!", "fr", "b", 1), (9, "é ñ ü 日本 😀 \u2581x", "fr", "b", None), (9, "another text with the same id", "fr", "b", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as shard", "1 as size", "'y' as score", "'z' as component_id", "0 as length", "'q' as spans")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def rng():
    return random.Random(7)
