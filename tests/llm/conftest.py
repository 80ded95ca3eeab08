import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, DOC_ID_ string, size string, t string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, repeated rows, empty and very long texts, columns with clashing names."""
    long_text = "alpha beta gamma delta. " * 30_000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", "x", "x"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", "x", "x"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "", "", ""),
        (None, "a text without an id, but with words", "en", "b", None, None, None, None),
        (5, " \t\n ", "en", None, 4, "x", "x", "x"),
        (6, long_text, "en", "c", len(long_text), "x", "x", "x"),
        (7, "x" * 300_000, "en", "c", 300_000, "x", "x", "x"),
        (8, "one", "en", "d", 3, "x", "x", "x"),
    ]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("DOC_ID_", "fp").repartition(3, F.col("n_chars"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
