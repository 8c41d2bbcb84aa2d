import pytest
from pyspark.sql import types as T

ROWS = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
#: Nulls, empty and very long texts, ties, repeated rows, odd characters.
EDGE = [
    (1, "The cat sat on the mat and then it sat on the hat.", "en", "a", 50),
    (1, "The cat sat on the mat and then it sat on the hat.", "en", "a", 50),
    (2, "The cat sat on the mat and then it sat on the hat.", "en", "a", 50),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "fr", "b", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " tail", None, "a", None),
    (None, "no id but some words here and there", "en", "b", 35),
    (8, "é " * 60 + "日本   \x1c x", "fr", "c", 130),
    (9, "a " * 300, "en", "c", 600),
    (10, "one", "en", None, 3),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, ROWS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture
def clashing(edge):
    """Extra columns with the names of working columns."""
    from pyspark.sql import functions as F

    for c in ("id", "comp", "_size", "_key", "_shard", "_slot", "_score", "_text", "_n_words", "_rest", "_h", "size", "target", "count", "shard", "slot", "a.b"):
        edge = edge.withColumn(c, F.lit(7))
    return edge


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (77, 0, 0)], LABELS)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "sat on the mat and then it sat on the hat one two three four"), (2, "no id but"), (3, None), (4, "..."), (None, "the cat"), (5, " ".join(f"W{i}" for i in range(40, 70)))], ITEMS)
