"""Awkward tables that every operator has to take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASH = ("key", "cls", "n", "size", "bands", "pattern", "bucket", "comp", "members", "copies", "score", "predicted", "h", "x", "digest", "salt", "chunk", "payload", "best", "host", "path", "rule", "v", "rank", "image", "media", "ids", "bytes", "a", "b")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 5), (2, "ONE two three four five six seven eight nine ten", None, "a", None), (3, None, "en", None, 0), (4, "", "de", "b", 0), (5, " \t\n ", None, None, 3),
    (6, "short", "fr", "b", 5), (7, LONG, "en", "b", len(LONG)), (8, LONG + " tail", "en", "c", 1), (None, "a null id here", "en", "c", 14), (9, "größe ÀÉ 你好    é 🙂🙂 don't  I'LL 12345", "zz", "c", 9),
    (10, "same row", "en", "a", 8), (10, "same row", "en", "a", 8), (None, None, None, None, None), (11, "x" * 5_000, "en", "a", 5_000), (12, "\x00\x01 control \x7f", "en", "a", 3),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(TEXTS, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators use inside."""

    def add(df):
        from pyspark.sql import functions as F

        have = {c.lower() for c in df.columns}
        return df.select("*", *(F.lit(f"extra-{c}").alias(c) for c in CLASH if c not in have))

    return add


@pytest.fixture(scope="session")
def as_set():
    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return rows
