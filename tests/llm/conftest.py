import os

import pytest
from pyspark.sql import types as T

# Python workers import the package by this path, wherever the tests were started.
os.environ["PYTHONPATH"] = os.pathsep.join(
    x for x in (os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH")) if x
)

LONG = "lorem ipsum dolor sit amet " * 40_000

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("cid", T.StringType()), T.StructField("score", T.StringType()), T.StructField("epoch", T.StringType()),
    T.StructField("slot", T.StringType()), T.StructField("sig", T.StringType()), T.StructField("h", T.StringType()),
])


def document(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None, "c", "s", "e", "x", "y", "z")


ODD = [
    document(1, "one two three four five six seven eight nine ten eleven"),
    document(2, "one two three four five six seven eight nine ten eleven", "t"),
    document(2, "one two three four five six seven eight nine ten eleven", "t"),  # a row again
    document(3, None),
    document(4, ""),
    document(5, " \t\n"),
    document(6, "word"),
    document(None, "one two three four five six seven eight nine ten eleven", None),
    document(None, None, None),
    document(7, LONG),
    document(8, "É ÀÉ ü 12 \x00 \ud7ff " * 30),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENTS)
