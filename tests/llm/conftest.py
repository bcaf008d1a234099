import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

AWKWARD = [
    (1, "Hello big world of words that go on", "en", "a"),
    (2, "HELLO big world of words that go on", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (5, "   \n\t ", None, "b"),
    (None, "no id here", "en", "a"),
    (6, "é ñ ß 你好 😀", "fr", "c"),
    (7, "short", "en", "a"),
    (7, "short", "en", "a"),
    (8, "long " * 20000 + "end", "en", "a"),
    (9, "12345 !!!", "en", "a"),
    (10, "Hello big world of words that go on", "en", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, lang, s, len(t or ""), "x", 1, True) for i, t, lang, s in AWKWARD]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size int, kept boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, node int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
