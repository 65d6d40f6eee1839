import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and then it runs to the river with all of the other foxes in that wood"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, PROSE, "en", "a", 10), (2, PROSE, "en", "b", 10), (2, PROSE, "en", "b", 10), (3, PROSE.upper(), None, None, None),
        (4, None, None, "a", None), (5, "", "en", "a", 0), (6, " \t\n ", "en", "b", 4), (None, PROSE + " end", "en", "a", 1),
        (None, None, None, None, None), (7, LONG, "en", "a", len(LONG)), (8, "password = abcdefgh12345678 ok", "en", "c", 1),
        (9, "one two", "en", "c", 7), (9, "other text", "en", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    out = docs
    for name in ("row", "id", "size", "key", "slice", "symbols", "fp", "k1", "k2", "nth", "component_key", "spans", "kept", "n_words", "words", "a.b", "cluster", "copies"):
        out = out.withColumn(name, out.doc_id.cast("string"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
