"""What the operators share: the definition of a word, session settings, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.session import configure

#: The characters between words, plain and as a pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"

#: Rows and bytes an Arrow batch holds at most, so that long texts stay bounded.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings of this subpackage; safe to call again."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A double in (0, 1) that depends on the seed and the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names; clashing extras stay out."""
    return docs.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


def carried(docs: DataFrame, **computed: Column) -> DataFrame:
    """``row`` holds all columns of ``docs``, whatever their names, beside computed ones."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in computed.items()])
