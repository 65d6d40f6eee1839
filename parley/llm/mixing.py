"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 3).

A source's target is a share of the wanted total by its weight, at most ``cap`` times
its size, the excess reshared by weight. A source takes whole epochs of all its
documents first, then documents in order of their exponential keys until the rest of
the target is met; the document on the border is taken if that lands nearer.

Keys are ``-ln(u) / quality`` with ``u`` drawn from the seed and the id, so reruns
agree. Only sums per (source, slice of the key range) are shuffled, first over coarse
slices, then over the fine ones of the coarse slice on the border; just the fine slice on
the border is sorted, so a source that holds a third of all rows is never sorted.

Null and empty texts have size 0 and take nothing. A null source is the last source.
Repeated rows share a key and are taken side by side. An empty table gives no rows.
The table of sources (one row each) is ranked in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.llm.common import carried, n_words, prepare, uniform
from parley.llm.quality import SYMBOLS
from parley.session import if_small, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: The key range has that many slices, and each as many fine ones.
SLICE_BITS = 12
SEED = 20
#: A table of that many sources (a few numbers each) may be broadcast.
SOURCE_ROWS = 50_000


def quality_weight(size: Column, symbols: Column) -> Column:
    """0.5 to 1: less for texts with many symbols per word."""
    return F.greatest(F.lit(0.5), 1.0 - symbols / F.greatest(size, F.lit(1)))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = SEED) -> DataFrame:
    """``row`` with its id, source, size, key and the slice of the key range it falls in."""
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    whole = F.coalesce(text, F.lit(""))
    made = carried(docs, id=ident, source=F.col(f"`{source_col}`"), size=n_words(text),
                   symbols=F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")))
    made = made.withColumn("key", -F.log(uniform(seed, F.col("id"))) / quality_weight(F.col("size"), F.col("symbols"))).drop("symbols")
    return made.withColumn("slice", F.floor((1 << 2 * SLICE_BITS) * (1.0 - F.exp(-F.col("key")))).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: shares by weight, filled up to each source's cap.

    Sources in order of cap per weight are full while the level, which is the rest of
    the total over the rest of the weights, reaches their cap; the others get the level
    times their weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))))
    ranked = total.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    line = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumns({"level": level, "at": F.row_number().over(line)})
    full = F.col("level") >= F.col("most") / F.col("weight")
    first = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.col("at"))).over(every)
    return filled.select("source", "source_size", F.when(full, F.col("most")).otherwise(first * F.col("weight")).alias("target"))


def edges(per_slice: DataFrame, want: DataFrame) -> DataFrame:
    """(of, edge, need): the slice in which the sum over the source's slices passes ``rest``, and what is missing before it.

    ``per_slice`` has source, at, size; ``want`` has of (a source) and rest.
    """
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    passed = per_slice.withColumn("upto", upto).join(want.select("of", "rest"), F.col("source").eqNullSafe(F.col("of"))).filter(F.col("upto") > F.col("rest"))
    need = F.col("rest") - F.col("upto") + F.col("size")
    return passed.groupBy("source").agg(F.min_by(F.struct(F.col("at").alias("edge"), need.alias("need")), "at").alias("e")).select(
        F.col("source").alias("of"), "e.edge", "e.need")


def plan(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: size, target, whole ``epochs``, and the fine slice on the border with what it still ``need``s."""
    want = targets(sizes, weights, share, cap).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    want = stage(want.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of"))
    coarse = F.shiftright("slice", SLICE_BITS)
    rough = stage(edges(sizes.groupBy("source", coarse.alias("at")).agg(F.sum("size").alias("size")), want))
    few = if_small(rough, SOURCE_ROWS)
    inside = sizes.join(rough if few is None else few, F.col("source").eqNullSafe(F.col("of")) & (coarse == F.col("edge")))
    fine = edges(inside.groupBy("source", F.col("slice").alias("at")).agg(F.sum("size").alias("size")),
                 rough.withColumnRenamed("need", "rest")).withColumnRenamed("of", "b")
    return want.join(fine, F.col("of").eqNullSafe(F.col("b")), "left").select("of", "source_size", "target", "epochs", "edge", "need")


def taken(made: DataFrame, chosen: DataFrame) -> DataFrame:
    """``made`` with source_size, target and ``copies``, the times each document is taken."""
    few = if_small(chosen, SOURCE_ROWS)
    rows = made.join(chosen if few is None else few, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside, border = F.col("slice") < F.col("edge"), F.col("slice") == F.col("edge")
    plain = rows.filter(~F.coalesce(border, F.lit(False))).withColumn("copies", F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long"))
    line = Window.partitionBy("source").orderBy("key", "id", "size")
    before = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.filter(border).withColumn("copies", F.col("epochs") + (2 * before + F.col("size") <= 2 * F.col("need")).cast("long"))
    return plain.unionByName(edge)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and ``taken`` words of every row."""
    prepare(docs.sparkSession)
    sizes = stage(measured(docs, id_col, text_col, source_col, seed).drop("row"))
    out = taken(sizes, stage(plan(sizes, weights, share, cap)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    prepare(docs.sparkSession)
    made = measured(docs, id_col, text_col, source_col, seed)
    chosen = stage(plan(stage(made.drop("row")), weights, share, cap))
    copies = taken(made, chosen).filter("copies > 0 and size > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
