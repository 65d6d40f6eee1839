"""Best-fit packing under conflicts (operator 8).

Texts become pieces of at most a bin's capacity in words. Pieces are dealt to shards of
bounded size by hash; in a shard they go, largest first, to the tightest bin that can
hold them. Bins are ordered by residual; each carries bitmaps of the duplicate clusters
in it and of the sources that have filled their part of it, and the search for a
successor goes on until a compatible bin is found, else a bin is opened. No piece is
dropped, and no bin holds two pieces of one cluster or more of a source than allowed.

A text longer than a bin gives full pieces, each in a bin of its own, and a rest. Null
and empty texts take no room: one row with size 0 and no bin. Rows that repeat are
copies of one cluster, so they lie in different bins. A null source is a source, a null
cluster conflicts with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import SPACE, SPACES, n_words, prepare
from parley.session import stage

CAPACITY = 2_048
PER_SOURCE = 4
SHARD_PIECES = 4_096

PACKED = "row_id bigint, piece bigint, start bigint, size bigint, bin string, slot int"


def copies_key(text: Column) -> Column:
    """The cluster of exact copies: equal up to case of A-Z and spacing."""
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), F.lit(SPACE))
    return F.xxhash64(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


class Shelf:
    """Open bins by residual. Words of a big number tell which residuals have bins."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0
        self.clusters: list[int] = []
        self.full: list[int] = []
        self.sources: list[dict[int, int]] = []
        self.slots: list[int] = []

    def fits(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] >> cluster & 1 if cluster >= 0 else 0) and not self.full[b] >> source & 1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the place in it."""
        left = self.present >> size
        residual = size
        while left:
            step = (left & -left).bit_length() - 1
            residual, left = residual + step, left >> step
            here = self.at[residual]
            for k in range(len(here) - 1, -1, -1):
                if self.fits(here[k], source, cluster):
                    b = here[k]
                    here[k] = here[-1]
                    here.pop()
                    if not here:
                        self.present &= ~(1 << residual)
                    return self._place(b, residual - size, source, cluster)
            residual, left = residual + 1, left >> 1
        self.clusters.append(0)
        self.full.append(0)
        self.sources.append({})
        self.slots.append(0)
        return self._place(len(self.slots) - 1, self.capacity - size, source, cluster)

    def _place(self, b: int, residual: int, source: int, cluster: int) -> tuple[int, int]:
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        n = self.sources[b][source] = self.sources[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= 1 << source
        if residual:
            self.at[residual].append(b)
            self.present |= 1 << residual
        self.slots[b] += 1
        return b, self.slots[b] - 1


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """``bin`` and ``slot`` for the pieces of a shard."""
    order = pieces.sort_values(["size", "cluster", "row_id", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    source, cluster = pd.factorize(order["source"], use_na_sentinel=False)[0], pd.factorize(order["cluster"])[0]
    shelf = Shelf(capacity, per_source)
    put = [shelf.put(*x) for x in zip(order["size"].tolist(), source.tolist(), cluster.tolist())]
    prefix = str(int(order["shard"].iloc[0]))
    order["bin"], order["slot"] = [f"{prefix}-{b}" for b, _ in put], [s for _, s in put]
    return order[["row_id", "piece", "start", "size", "bin", "slot"]]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None,
         capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, size, bin, slot: words [start, start + size) of the text lie in that bin."""
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    key = copies_key(text) if cluster is None else F.when(cluster.isNotNull(), F.xxhash64(cluster))
    # numbered once, in the written table, so that a rerun of a task sees the same numbers
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").alias("doc_id"),
                             F.col(f"`{source_col}`").alias("source"), key.alias("cluster"), n_words(text).alias("words")))
    of = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / capacity))).alias("piece")
    cut = rows.filter("words > 0").select("*", of).withColumn("start", F.col("piece") * capacity)
    cut = cut.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start")))
    n = rows.agg(F.sum(F.ceil(F.col("words") / capacity))).first()[0] or 0
    shards = max(1, -(-n // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row_id", "piece"), F.lit(shards)).cast("int"))
    packed = dealt.select("shard", "row_id", "piece", "start", "size", "source", F.col("cluster").cast("string").alias("cluster")).groupBy("shard").applyInPandas(
        lambda pieces: pack_shard(pieces, capacity, per_source), PACKED)
    ids = rows.select("row_id", "doc_id")
    empty = rows.filter("words = 0").selectExpr("doc_id", "0L AS piece", "0L AS start", "0L AS size", "CAST(NULL AS STRING) AS bin", "CAST(NULL AS INT) AS slot")
    return packed.join(ids, "row_id").drop("row_id").select(empty.columns).unionByName(empty)
