"""Ordered work per key when one key may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here the row
count per key is taken first (a combining aggregate over the key columns only).
Keys of ordinary size keep the plain window. The rows of larger keys are range
partitioned on (key, order), which cuts such a key into consecutive slices of
bounded size; work inside a slice is local, and slice totals, one row each,
carry the running state from slice to slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.session import stage

SLICE_ROWS = 1_000_000   # rows one task sorts for one key
PART_ROWS = 10_000       # rows one output array holds
BROADCAST_KEYS = 100_000  # large keys sent to every executor, at most

_ONE = "_one"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """A global order is an order within one constant key."""
    if keys:
        return df, list(keys), False
    return df.withColumn(_ONE, F.lit(1)), [_ONE], True


@dataclass(frozen=True)
class LargeKeys:
    """The keys of a table with more than ``limit`` rows."""

    table: DataFrame
    n: int
    rows: int
    limit: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ordinary keys and rows of large ones."""
        keys = self.table.columns
        big = F.broadcast(self.table) if self.n <= BROADCAST_KEYS else self.table
        return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")


def large_keys(df: DataFrame, keys: Sequence[str], limit: int = SLICE_ROWS) -> LargeKeys:
    """One combining count over the key columns. A table that holds no more rows
    per key, such as a filtered one, may reuse the answer."""
    big = df.groupBy(*keys).count().where(F.col("count") > limit)
    n, rows = big.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    return LargeKeys(big.select(*keys), n, rows, limit)


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int = SLICE_ROWS,
           large: LargeKeys | None = None) -> tuple[DataFrame, bool]:
    """Add ``_slice``: 0 for ordinary keys, 1.. in order within a large key."""
    large = large or large_keys(df, keys, limit)
    if large.n == 0:
        return df.withColumn("_slice", F.lit(0)), False
    cold, hot = large.split(df)
    count = -(-large.rows // large.limit) + 1
    cut = hot.repartitionByRange(count, *keys, *order).withColumn("_slice", F.spark_partition_id() + 1)
    # range bounds are sampled: fix them before several branches read them
    return cold.withColumn("_slice", F.lit(0)).unionByName(stage(cut)), True


def with_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                       weight: Column | None = None, out: str = "pos", limit: int = SLICE_ROWS,
                       large: LargeKeys | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the key before this one.

    Without a weight it is the 0-based position in the key. ``order`` must be
    total; key columns must not be null.
    """
    df, keys, dummy = _keyed(df, keys)
    cut, is_cut = slices(df, keys, order, limit, large)
    w = W.partitionBy(*keys, "_slice").orderBy(*order)
    if weight is None:
        local = F.row_number().over(w).cast("long") - 1
        weight = F.lit(1).cast("long")
    else:
        local = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, 0)) - weight
    res = cut.withColumn(out, local)
    if is_cut:
        earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        offset = (
            cut.where("_slice > 0").groupBy(*keys, "_slice").agg(F.sum(weight).alias("_sum"))
            .select(*keys, "_slice", F.sum("_sum").over(earlier).alias("_offset"))
        )
        res = (
            res.join(offset, [*keys, "_slice"], "left")
            .withColumn(out, F.col(out) + F.coalesce("_offset", F.lit(0)))
            .drop("_offset")
        )
    res = res.drop("_slice")
    return res.drop(_ONE) if dummy else res


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "pos",
                  limit: int = SLICE_ROWS, large: LargeKeys | None = None) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return with_running_total(df, keys, order, None, out, limit, large)


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bound: int,
               out: str = "pos") -> DataFrame:
    """As ``with_position`` where no key can hold more than ``bound`` rows."""
    if bound > SLICE_ROWS:
        return with_position(df, keys, order, out)
    w = W.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long") - 1)


def collect_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  item: Column, out: str, rows: int = PART_ROWS, limit: int = SLICE_ROWS,
                  large: LargeKeys | None = None, ahead: int = 0) -> DataFrame:
    """(keys, part, out): items of each key in order, ``rows`` to an array.

    A key of ordinary size has the one part 0; a larger one has as many rows as
    it needs, so no array grows without bound and nothing is left out. With
    ``ahead``, ``following`` holds as many first items of the next part.
    """
    placed = with_position(df.withColumn("_item", item), keys, order, "_pos", limit, large)
    part = F.floor(F.col("_pos") / rows)
    if ahead:
        opens = (F.col("_pos") >= rows) & (F.col("_pos") - part * rows < ahead)
        placed = placed.withColumn("_part", F.explode(F.when(opens, F.array(part, part - 1)).otherwise(F.array(part))))
        part = F.col("_part")
    made = placed.groupBy(*keys, part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("_pos", "_item"))).alias("_items"))
    if not ahead:
        return made.select(*keys, "part", F.col("_items._item").alias(out))
    end = (F.col("part") + 1) * rows
    own = F.filter("_items", lambda x: x["_pos"] < end)
    after = F.filter("_items", lambda x: x["_pos"] >= end)
    return made.select(*keys, "part", F.transform(own, lambda x: x["_item"]).alias(out), F.transform(after, lambda x: x["_item"]).alias("following"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              limit: int = SLICE_ROWS) -> DataFrame:
    """(keys, n, p50, p95) exactly, for keys of any size.

    Equal values are first counted together on the map side. p50 is the usual
    median; p95 is the exclusive 20-quantile, which may lie beyond the largest
    value; a single value is its own p95.
    """
    df, keys, dummy = _keyed(df, keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    )
    placed = with_running_total(counts, keys, ["_v"], F.col("_c"), "_before", limit)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    n = F.col("n")
    j = F.greatest(F.least(F.expr("19 * (n + 1) div 20"), n - 1), F.lit(1))
    delta = F.lit(19) * (n + 1) - F.lit(20) * j

    def at(rank: Column) -> Column:
        inside = (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_c"))
        return F.max(F.when(inside, F.col("_v")))

    res = (
        placed.join(totals, list(keys)).groupBy(*keys, "n")
        .agg(at(F.expr("(n + 1) div 2")).alias("_m1"), at(F.expr("n div 2 + 1")).alias("_m2"),
             at(j).alias("_lo"), at(j + 1).alias("_hi"))
        .select(
            *keys, "n", ((F.col("_m1") + F.col("_m2")) / 2).alias("p50"),
            F.when(n == 1, F.col("_lo"))
            .otherwise((F.col("_lo") * (F.lit(20) - delta) + F.col("_hi") * delta) / 20)
            .alias("p95"),
        )
    )
    return res.drop(_ONE) if dummy else res


def _hashed(df: DataFrame, id_col: str, seed: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash ``_h`` and its leading digits ``_b``, and how many rows come before each such group."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 4))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offset = hashed.groupBy(*keys, "_b").count().select(
        *keys, "_b", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    return hashed, offset


def with_hash_position(df: DataFrame, id_col: str, seed: str, keys: Sequence[str] = (),
                       out: str = "pos") -> DataFrame:
    """Add the 0-based place of each row in a random order fixed by ``seed``.

    The order is that of md5(seed, id), the same on any cluster. Rows are counted
    per leading hash digits, so only rows that share them meet in one task, even
    when ``keys`` has a single value.
    """
    df, keys, dummy = _keyed(df, keys)
    hashed, offset = _hashed(df, id_col, seed, keys)
    w = W.partitionBy(*keys, "_b").orderBy("_h", id_col)
    res = (
        hashed.join(offset, [*keys, "_b"])
        .withColumn(out, F.col("_offset") + F.row_number().over(w) - 1)
        .drop("_h", "_b", "_offset")
    )
    return res.drop(_ONE) if dummy else res


def first_by_hash(df: DataFrame, id_col: str, seed: str, n: int | Column, keys: Sequence[str] = (),
                  wanted: DataFrame | None = None, out: str = "pos") -> DataFrame:
    """The rows at the first ``n`` places of ``with_hash_position``, with their place.

    ``n`` is a number, or a column of ``wanted``, a small table by ``keys``. Only groups
    of hash digits that begin before the n-th place are read again, shuffled and sorted:
    about n rows, not the population.
    """
    df, keys, dummy = _keyed(df, keys)
    hashed, offset = _hashed(df, id_col, seed, keys)
    limit = F.lit(n) if isinstance(n, int) else n
    if wanted is not None:
        offset = offset.join(wanted, keys)
    # written, so that the planner knows that it is small
    early = stage(offset.withColumn("_n", limit).where(F.col("_offset") < F.col("_n")).select(*keys, "_b", "_offset", "_n"))
    w = W.partitionBy(*keys, "_b").orderBy("_h", id_col)
    res = (
        hashed.join(early, [*keys, "_b"])
        .withColumn(out, F.col("_offset") + F.row_number().over(w) - 1)
        .where(F.col(out) < F.col("_n")).drop("_h", "_b", "_offset", "_n")
    )
    return res.drop(_ONE) if dummy else res
