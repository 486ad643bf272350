import pytest
from pyspark.sql import functions as F

ODD = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, None, 4),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (4, "an other text under the same id", "en", "b", 3),
    (None, "a text without any id", "en", None, 3),
    (5, "word " * 30_000 + "é" * 20_000, "en", "a", 170_000),
    (6, "a" * 5_000, "en", "a", 5_000),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    extra = ("id", "ka", "kb", "row", "n", "size", "words", "kept", "node", "start", "hits", "word", "target")
    return rows.withColumns({name: F.lit(name) for name in extra})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
