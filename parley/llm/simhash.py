"""SimHash near-duplicates found with vantage-point trees (operator 6).

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one
point. A tree of vantage points, drawn from a bounded sample, cuts the points by
Hamming distance into shards; a point lives in one shard, and visits every later shard
whose boundary lies within the radius. In a shard a second tree over its points answers
the visits exactly: a branch is left out only where the triangle inequality rules out
a hit. A shard with many points or visits is cut into blocks, and each block of visits
meets each block of points, so a task holds a bounded number of either. Each task returns
a spanning forest of its links, never all pairs of a group, and components are joined
across shards.

Null and empty texts, and texts without words, have fingerprint zero and link like any
other. Repeated rows and exact copies share a point. A null doc_id takes part; a
component of null ids alone has a null id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from parley.llm.common import picked, prepare
from parley.llm.graph import components
from parley.session import stage

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Points a shard is meant to hold, points a leaf holds, fingerprints the top tree is fitted on.
SHARD_POINTS = 16_384
LEAF_POINTS = 64
#: Levels of the top tree at most; own points and visits one task holds, about.
TOP_LEVELS = 11
MEMBER_POINTS = 65_536
VISIT_POINTS = 1 << 20
SAMPLE_POINTS = 4_096
#: Comparisons held in memory at once.
BLOCK = 1 << 21
#: Hashes unpacked to bits at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and only the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``fp`` and the row's identity (k1, k2), a hash of id and text, of every row."""
    prepare(docs.sparkSession)
    bare = identified(picked(docs, doc_id=id_col, text=text_col)).withColumn("text", F.col("text").cast("binary"))

    def made(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "fp"])

    return bare.mapInArrow(made, f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, fp bigint")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds 128 bits that rows of the same id and text share."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.withColumns({"k1": F.xxhash64(ident, text), "k2": F.xxhash64(F.lit("second"), text, ident)})


class Tree:
    """A vantage-point tree over distinct uint64 points; leaves hold positions."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 64) -> None:
        self.points = points
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(points)), leaf, depth)

    def _grow(self, own: np.ndarray, leaf: int, depth: int):
        if len(own) > leaf and depth > 0:
            vantage = self.points[own[len(own) // 2]]
            d = np.bitwise_count(self.points[own] ^ vantage).astype(np.int16)
            cut = int(np.median(d))
            if (d <= cut).all():
                cut = int(d.max()) - 1
            inner = d <= cut
            if inner.any():
                return (vantage, cut, self._grow(own[inner], leaf, depth - 1), self._grow(own[~inner], leaf, depth - 1))
        self.leaves.append(own)
        return len(self.leaves) - 1


def reached(node, queries: np.ndarray, radius: int, own: np.ndarray | None = None):
    """(leaf, positions of the queries that must look into it)."""
    stack = [(node, np.arange(len(queries)) if own is None else own)]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        vantage, cut, inner, outer = node
        d = np.bitwise_count(queries[at] ^ vantage).astype(np.int16)
        stack.append((inner, at[d - radius <= cut]))
        stack.append((outer, at[d + radius > cut]))


class Forest:
    """Union-find over positions that keeps the links which joined two sets."""

    def __init__(self, n: int) -> None:
        self.root, self.kept = np.arange(n), []

    def _flat(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            new = self.root[a] != self.root[b]
            a, b = a[new], b[new]
            if not len(a):
                return
            for x, y in zip(a[:1024].tolist(), b[:1024].tolist()):
                rx, ry = self._find(x), self._find(y)
                if rx != ry:
                    self.root[max(rx, ry)] = min(rx, ry)
                    self.kept.append((x, y))
            a, b = a[1024:], b[1024:]
            self._flat()


def forest(members: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, leaf: int = LEAF_POINTS, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius among members and from visitors to members.

    Without ``among`` only the visitors ask.
    """
    queries = np.concatenate([members, visitors])
    sets = Forest(len(queries))
    tree = Tree(members, leaf)
    step = 1 << 13
    for at in range(0 if among else len(members), len(queries), step):
        for number, ask in reached(tree.root, queries, radius, np.arange(at, min(at + step, len(queries)))):
            inside = tree.leaves[number]
            rows = max(1, BLOCK // len(inside))
            for lo in range(0, len(ask), rows):
                block = ask[lo : lo + rows]
                near = np.bitwise_count(queries[block][:, None] ^ members[inside][None, :]) <= radius
                i, j = np.nonzero(near)
                sets.add(block[i], inside[j])
    kept = np.array(sets.kept, np.int64).reshape(-1, 2)
    return queries[kept[:, 0]], queries[kept[:, 1]]


def _placed(root, radius: int):
    def place(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home = np.full(len(fp), -1, np.int32)
            for leaf, at in reached(root, fp, 0):
                home[at] = leaf
            rows = [(home, fp, np.ones(len(fp), bool))]
            for leaf, at in reached(root, fp, radius):
                at = at[home[at] < leaf]
                rows.append((np.full(len(at), leaf, np.int32), fp[at], np.zeros(len(at), bool)))
            shard, points, own = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(points.view(np.int64)), pa.array(own)], ["shard", "fp", "own"])
    return place


def blocks(placed: DataFrame, member_points: int, visit_points: int, by: str = "fp") -> DataFrame:
    """(shard, members, visits, points' columns, own): every point in its block of members beside each block of visits.

    Visits, and points as visits to later blocks of their own shard, go to each block of
    members. ``by`` tells points apart. The table of shards has at most 2 ** TOP_LEVELS rows
    for each fingerprint searched, so it is broadcast.
    """
    carried = [c for c in placed.columns if c not in ("shard", "own")]
    some = lambda n, size: F.greatest(F.lit(1), F.ceil(F.sum(n.cast("long")) / size)).cast("int")
    cuts = placed.groupBy("shard").agg(some(F.col("own"), member_points).alias("m"), some(~F.col("own"), visit_points).alias("v"))
    dealt = placed.join(F.broadcast(cuts), "shard").withColumns(
        {"home": F.pmod(F.xxhash64(by), "m").cast("int"), "ask": F.pmod(F.xxhash64(by, F.lit(1)), "v").cast("int")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda members, visits, own: F.struct(members.alias("members"), visits.alias("visits"), F.lit(own).alias("own"))
    asked = F.when(F.col("own"), F.filter(every("m"), lambda x: x > F.col("home"))).otherwise(every("m"))
    lives = F.when(F.col("own"), every("v")).otherwise(F.array().cast("array<int>"))
    spots = F.concat(F.transform(lives, lambda x: place(F.col("home"), x, True)), F.transform(asked, lambda x: place(x, F.col("ask"), False)))
    return dealt.select("shard", *carried, F.explode(spots).alias("at")).select("shard", "at.members", "at.visits", *carried, "at.own")


def links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS,
          member_points: int = MEMBER_POINTS, visit_points: int = VISIT_POINTS) -> DataFrame:
    """(a, b) links between the distinct ``fp`` of ``points`` that connect all within the radius."""
    n = points.count()
    drawn = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_POINTS).collect()
    sample = np.array([r.fp for r in drawn], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard_points)))) if n else 0
    top = Tree(sample, 1, min(depth, TOP_LEVELS))
    placed = stage(points.select("fp").mapInArrow(_placed(top.root, radius), "shard int, fp bigint, own boolean"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        fp, own = group["fp"].to_numpy(np.int64).view(np.uint64), group["own"].to_numpy(bool)
        members, visitors = np.sort(fp[own]), np.sort(fp[~own])
        first = group["visits"].iloc[0] == 0
        a, b = forest(members, visitors, radius, among=bool(first)) if len(members) else (fp[:0], fp[:0])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = blocks(placed, member_points, visit_points)
    return dealt.groupBy("shard", "members", "visits").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` (the least id reachable) of every row.

    ``component_key`` is the least fingerprint of the component, never null.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle))
    points = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(points, radius))
    keyed = points.join(root.select(F.col("a").alias("fp"), F.col("b").alias("up")), "fp", "left").withColumn(
        "component_key", F.coalesce("up", "fp"))
    ids = keyed.groupBy("component_key").agg(F.min("least").alias("component_id"))
    found = stage(keyed.select("fp", "component_key").join(ids, "component_key"))
    return fps.join(found, "fp").select("doc_id", "k1", "k2", "fp", "component_id", "component_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id, all columns kept."""
    return heads_of(docs, near_duplicates(docs, id_col, text_col, shingle, radius), id_col, text_col)


def heads_of(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the least id of each component of ``found``, all columns kept.

    Of several texts under that id the one of the least hash stays, and of equal rows one.
    """
    heads = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_key").agg(
        F.min(F.struct("k1", "k2")).alias("head")).select("head.*")
    bare = identified(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                  F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    kept = bare.select("row", "k1", "k2").join(stage(heads), ["k1", "k2"])
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64("row")))
    return kept.withColumn("nth", first).filter("nth = 1").select("row.*")
