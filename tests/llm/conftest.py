"""Small tables for the training-data operators."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, c string"
ODD = [
    (1, "Ärger And more", "de", "s1", 1, "x", "y"),
    (2, "Ärger and MORE", "de", "s1", 1, "x", "y"),
    (2, "Ärger and MORE", "de", "s1", 1, "x", "y"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "s2", 0, None, None),
    (None, "ärger And more", "en", "s2", 0, None, None),
    (5, "   \t\n ", "en", None, 0, None, None),
    (6, "one line\none line\n\nÄrger and more", "en", "s2", 0, None, None),
    (7, "word " * 30_000, "en", "s2", 0, None, None),
    (8, "x" * 60_000, "fr", "s3", 0, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and extra columns with names the operators use."""
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(10)] + [(1, None, 1), (None, 1, 1), (2, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
