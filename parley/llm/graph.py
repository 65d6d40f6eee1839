"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.session import stage


def _large(e: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours on its smallest one."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the smallest of them."""
    least = e.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = e.join(least, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("n", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of the graph that is not its component's least, with that least one.

    ``edges`` has two columns of one ordered type. Each round is written to the shared
    folder, and the number of rounds grows with the logarithm of the longest path.
    """
    x, y = (F.col(f"`{c}`") for c in edges.columns)
    e = stage(edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    while True:
        nested = e.select("b").join(e.select(F.col("a").alias("b")), "b", "left_semi")
        if nested.isEmpty() and e.groupBy("a").count().filter("count > 1").isEmpty():
            return e
        e = stage(_small(_large(e)))
