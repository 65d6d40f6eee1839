"""Texts that share most of their word shingles: every pair of them links (operator 6, wider).

Two texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 or
more. Two rounds find the classes of these links. The first is quick and finds most: each
set has five independent 24-bit SimHash fingerprints, and a vantage-point tree for each
finds the pairs within one bit. Their 128 bits also sketch the similarity; pairs more than
``SKETCH_BITS`` apart or of sizes that exclude 0.8 are dropped, and of the pairs a task
finds it hands on a forest that spans them, nearest pairs first. Each handed-on pair is
compared exactly, and what links is one class.

The second round leaves no pair out. Two sets of similarity 0.8 differ in a ninth of their
sizes' sum at most. All shingles are dealt by hash into some more parts than that, the
number fixed for each power of two of the size, so most parts of two such sets are equal,
and of each set the parts that a bounded number of differences cannot all reach are its
heads: about a quarter of its size, three shingles each, those with most shingles that few
texts share first. Sets of different classes with a head in common are compared exactly
too, unless their sizes or a bit for each shingle exclude the similarity: first each with
the next in size under a head, then, of the classes still apart, all. Pairs inside a class
have nothing to add, so a large group of near copies is never expanded. A set whose
shingles lie in too few parts is also met by the first n - ceil(0.8 n) + 1 of its shingles.

A text of fewer than five words is one shingle; texts without words (null, empty, blank)
have the empty set and are one class. Words are as in ``simhash``; equal sets are one point,
told apart by 64-bit hashes, as shingles are. Repeated rows share a point, a null doc_id
takes part, and a component of null ids alone has a null id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.llm.common import picked, prepare
from parley.llm.graph import components
from parley.llm.simhash import BLOCK, LEAF_POINTS, SAMPLE_POINTS, SEED, TOP_LEVELS, Forest, Tree, blocks, heads_of, identified, reached
from parley.session import discard, stage

SHINGLE = 5
#: The least similarity that links, as a fraction.
SIMILAR = (4, 5)
#: 24-bit fingerprints searched, bits they may differ in, and bits 128 sketch bits may.
SLICES, RADIUS, SKETCH_BITS = 5, 1, 38
#: Points a shard is meant to hold; points and visits a task holds; pairs before they are thinned to a forest.
SHARD_POINTS = MEMBER_POINTS = 65_536
VISIT_POINTS = 1 << 18
PAIRS = 1 << 21
#: Shingles a batch of texts names as shared by several of them, and all batches together.
BATCH_COMMON, COMMON = 1 << 12, 1 << 16
#: 64-bit words of the bits by which sets that share a head are told apart.
FOLD = 16
#: 64-bit words that hold all fingerprints.
WORDS = SLICES * 24 // 64 + 1


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64))


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - 2**63


def remixed(hashes: np.ndarray) -> np.ndarray:
    """(n, WORDS): independent 64-bit hashes of 64-bit hashes."""
    x = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray) -> bytes:
    """All fingerprints of a set: each bit the majority of that bit in its hashes."""
    ones = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), 255):  # a byte holds the sum of 255 bits
        bits = np.unpackbits(remixed(hashes[at : at + 255]).view(np.uint8).reshape(-1), bitorder="little")
        ones += np.add.reduce(bits.reshape(-1, WORDS * 64), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def parity(hashes: np.ndarray, size: int | None = None) -> bytes:
    """``size`` bits, two to four for each hash of a set if not given, each turned by every hash that falls on it.

    Two sets differ in at least as many hashes as their bits differ.
    """
    size = size or max(64, 2 << max(0, len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).view(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Hashes, at least, that two sets of these ``parity`` bits do not share; the longer bits are folded."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the row's identity (k1, k2), its set's ``key`` and size ``n``, ``bits``, ``turned`` and ``fold`` of every row.

    One row of a batch names in ``common`` shingles that several of its sets hold, in so many as ``times`` says.
    """
    prepare(docs.sparkSession)
    bare = identified(picked(docs, doc_id=id_col, text=text_col)).withColumn("text", F.col("text").cast("binary"))

    def made(batches):
        for b in batches:
            keys, sizes, bits, turned, fold, sets = [], [], [], [], [], {}
            for t in b.column("text").to_pylist():
                own = shingle_set(t, shingle)
                keys.append(key_of(own))
                sizes.append(len(own))
                bits.append(signature(own))
                turned.append(parity(own))
                fold.append(np.frombuffer(parity(own, 64 * FOLD), np.int64))
                sets[keys[-1]] = own
            rest = [None] * (len(keys) - 1)
            tokens, times = ([x, *rest][: len(keys)] for x in shared(list(sets.values())))
            columns = [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()),
                       pa.array(turned, pa.binary()), pa.array(fold, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "key", "n", "bits", "turned", "fold", "common", "times"])

    return bare.mapInArrow(made, f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, key bigint, n bigint, bits binary, "
                                 "turned binary, fold array<bigint>, common array<bigint>, times array<bigint>")


def shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that most sets hold, two at least, and the number of these sets."""
    tokens, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    tokens, times = tokens[times > 1], times[times > 1]
    most = np.lexsort((tokens, -times))[:BATCH_COMMON]
    return tokens[most].view(np.int64), times[most]


def _unpacked(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(points, SLICES) fingerprints and (points, 2) sketch words."""
    whole = np.frombuffer(b"".join(bits), np.uint8).reshape(-1, WORDS * 8)
    threes = whole[:, : SLICES * 3].reshape(-1, SLICES, 3).astype(np.uint32)
    return threes[:, :, 0] | threes[:, :, 1] << 8 | threes[:, :, 2] << 16, whole.view(np.uint64)[:, :2]


def _placed(tops: list, radius: int):
    """Every point in its shard of each fingerprint, and its visits to later shards across a boundary."""
    def place(batches):
        for b in batches:
            fps, sketch = _unpacked(b.column("bits").to_pylist())
            key, size = b.column("key").to_numpy(), b.column("n").to_numpy()
            for number, top in enumerate(tops):
                fp = fps[:, number]
                home = np.full(len(fp), -1, np.int32)
                for leaf, at in reached(top, fp, 0):
                    home[at] = leaf
                rows = [(home, np.arange(len(fp)), np.ones(len(fp), bool))]
                for leaf, at in reached(top, fp, radius):
                    at = at[home[at] < leaf]
                    rows.append((np.full(len(at), leaf, np.int32), at, np.zeros(len(at), bool)))
                shard, at, own = (np.concatenate(x) for x in zip(*rows))
                columns = [shard + (number << TOP_LEVELS), fps[at, number].astype(np.int64), key[at], size[at],
                           sketch[at, 0].view(np.int64), sketch[at, 1].view(np.int64), own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "fp", "key", "n", "s1", "s2", "own"])
    return place


class Nearest:
    """A forest that spans the pairs added so far, nearest pairs first."""

    def __init__(self, sketch: np.ndarray) -> None:
        self.sketch, self.held, self.a, self.b = sketch, 0, [], []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > PAIRS:
            self.forest()

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of the forest; all other pairs are forgotten, which no later pair can undo."""
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.a, self.b))
        order = np.lexsort((b, a, differing(self.sketch[a], self.sketch[b])))
        sets = Forest(len(self.sketch))
        for at in range(0, len(order), 1 << 16):
            some = order[at : at + (1 << 16)]
            sets.add(a[some], b[some])
        kept = np.array(sets.kept, np.int64).reshape(-1, 2)
        self.a, self.b, self.held = [kept[:, 0]], [kept[:, 1]], 0
        return kept[:, 0], kept[:, 1]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def nearest_links(fp: np.ndarray, size: np.ndarray, sketch: np.ndarray, members: int, among: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a forest's links; the first ``members`` points are searched, the rest visit them.

    Without ``among`` only the visitors ask.
    """
    found, low, high = Nearest(sketch), *SIMILAR
    tree, inner = Tree(fp[:members], LEAF_POINTS), fp[:members]
    step = 1 << 13
    for at in range(0 if among else members, len(fp), step):
        for number, ask in reached(tree.root, fp, radius, np.arange(at, min(at + step, len(fp)))):
            inside = tree.leaves[number]
            rows = max(1, BLOCK // len(inside))
            for lo in range(0, len(ask), rows):
                block = ask[lo : lo + rows]
                i, j = np.nonzero(np.bitwise_count(fp[block][:, None] ^ inner[inside][None, :]) <= radius)
                a, b = block[i], inside[j]
                once = a > b
                a, b = a[once], b[once]
                small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                fits = (high * small >= low * large) & (differing(sketch[a], sketch[b]) <= SKETCH_BITS)
                if fits.any():
                    found.add(a[fits], b[fits])
    return found.forest()


def candidates(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS,
               member_points: int = MEMBER_POINTS, visit_points: int = VISIT_POINTS) -> DataFrame:
    """Distinct (a, b), keys of ``points`` (key, n, bits) that may be similar, a > b."""
    n = points.count()
    drawn = points.select("bits").orderBy(F.xxhash64("key"), "key").limit(SAMPLE_POINTS).collect()
    sample, _ = _unpacked([bytes(r.bits) for r in drawn])
    depth = min(TOP_LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / shard_points)))))
    tops = [Tree(np.unique(sample[:, s]), 1, depth).root for s in range(SLICES)]
    placed = points.select("key", "n", "bits").mapInArrow(
        _placed(tops, radius), "shard int, fp bigint, key bigint, n bigint, s1 bigint, s2 bigint, own boolean")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["own", "fp", "key"], ascending=[False, True, True], ignore_index=True)
        key, members = group["key"].to_numpy(np.int64), int(group["own"].sum())
        a = b = np.zeros(0, np.int64)
        if members:
            sketch = group[["s1", "s2"]].to_numpy(np.int64).view(np.uint64)
            a, b = nearest_links(group["fp"].to_numpy(np.int64).astype(np.uint32), group["n"].to_numpy(np.int64), sketch,
                                 members, group["visits"].iloc[0] == 0, radius)
        return pd.DataFrame({"a": np.maximum(key[a], key[b]), "b": np.minimum(key[a], key[b])})

    dealt = blocks(placed, member_points, visit_points, "key")
    return dealt.groupBy("shard", "members", "visits").applyInPandas(search, "a bigint, b bigint").distinct()


def similar(pairs: DataFrame, docs: DataFrame, points: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The ``pairs`` whose sets have the similarity, by the sets themselves, read from one row of each.

    Pairs that ``turned`` shows to be too far apart are dropped before the sets are read.
    """
    low, high = SIMILAR

    def kept(batches):
        for b in batches:
            far = np.array([apart(x, y) for x, y in zip(b.column("turned_a").to_pylist(), b.column("turned_b").to_pylist())], np.int64)
            sizes = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((low + high) * far <= (high - low) * sizes))

    for c in ("a", "b"):
        pairs = pairs.join(points.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("turned").alias(f"turned_{c}")), c)
    pairs = stage(pairs.mapInArrow(kept, "a bigint, b bigint"))
    asked = stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(points, "key").select("key", "head.*"))
    bare = identified(picked(docs, doc_id=id_col, text=text_col)).select("k1", "k2", F.col("text").cast("binary").alias("text"))

    def made(batches):
        for b in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "own"])

    texts = bare.join(asked, ["k1", "k2"]).select("key", "text").mapInArrow(made, "key bigint, own array<bigint>")
    sets = stage(texts.groupBy("key").agg(F.first("own").alias("own")))
    left, right = (sets.select(F.col("key").alias(c), F.col("own").alias(f"of_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    links = stage(pairs.join(left, "a").join(right, "b").filter(high * both >= low * (F.size("of_a") + F.size("of_b") - both)).select("a", "b"))
    for done in (pairs, asked, sets):
        discard(done)
    return links


def levels(n: int) -> list[tuple[int, int]]:
    """(level, most) of a set of ``n`` shingles: the powers of two whose sets it meets, and the shingles, at most, it differs in from a similar one there.

    The smaller set of a pair gives the level.
    """
    low, high = SIMILAR
    level = n.bit_length() - 1
    own = [(level, (high - low) * (n + high * n // low) // (low + high))]
    under = (1 << level) - 1  # the largest set of the level below
    return own + [(level - 1, (high - low) * (n + under) // (low + high))] * (high * under >= low * n)


def parts(own: np.ndarray, level: int, common: np.ndarray) -> np.ndarray:
    """A hash of each part of a set that holds a shingle, parts of most shingles outside the sorted ``common`` first, then of most."""
    low, high = SIMILAR
    number = 6 * ((high - low) * (2 << level) // low) // 5 + 2
    mixed = remixed(own)
    part = (mixed[:, 0] % np.uint64(number)).view(np.int64)
    held = np.bincount(part, minlength=number)
    rare = held
    if len(common):
        rare = np.bincount(part[common[np.minimum(np.searchsorted(common, own), len(common) - 1)] != own], minlength=number)
    some = np.flatnonzero(held)
    held, rare = held[some], rare[some]
    sums = np.add.reduceat(mixed[np.argsort(part, kind="stable"), 1], np.cumsum(held) - held)
    told = remixed(sums ^ remixed((some + (level << 32)).view(np.uint64))[:, 0])[:, 0]
    return told[np.lexsort((told, -held, -rare))]


def heads_of_set(own: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Hashes of which any set similar to ``own`` has one too; ``times`` says how many sets hold the ``common``."""
    low, high = SIMILAR
    found = []
    for level, most in levels(len(own)):
        told = parts(own, level, common)
        found.append(told[: most + 1])
        if len(told) <= most:  # as many differences could reach every part
            at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
            rank = np.where(common[at] == own, times[at], 0) if len(common) else np.zeros(len(own), np.int64)
            found.append(own[np.argsort(rank, kind="stable")][: len(own) + 1 + -low * len(own) // high])
    return np.unique(np.concatenate(found))


def prefixes(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(token, key): the heads of every set, of which any similar set has one too.

    Heads that one set alone has are left out. Copies are told by their key, so no text is moved. Sets of fewer than four shingles have no similar set but themselves.
    """
    counted = rows.filter("common IS NOT NULL").select(F.explode(F.arrays_zip("common", "times")).alias("one")).groupBy("one.common").agg(F.sum("one.times").alias("times"))
    often = np.array(counted.orderBy(F.desc("times"), "common").limit(COMMON).collect(), np.int64).reshape(-1, 2)
    often = often[np.argsort(often[:, 0].view(np.uint64))]
    late, rank = often[:, 0].copy().view(np.uint64), often[:, 1].copy()

    def made(batches):
        for b in batches:
            sets = {key_of(own): own for own in (shingle_set(t, shingle) for t in b.column("text").to_pylist()) if len(own) >= SIMILAR[0]}
            heads = [heads_of_set(own, late, rank) for own in sets.values()]
            counts = np.array([len(h) for h in heads], np.int64)
            columns = [np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64), np.repeat(np.array(list(sets), np.int64), counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "key"])

    placed = picked(docs, text=text_col).select(F.col("text").cast("binary").alias("text")).mapInArrow(made, "token bigint, key bigint")
    order = Window.partitionBy("token").orderBy("key")
    beside = placed.withColumns({"before": F.lag("key").over(order), "after": F.lead("key").over(order)})
    return beside.filter("(before IS NULL AND after IS NOT NULL) OR before <> key").select("token", "key")


def meeting(heads: DataFrame, points: DataFrame, root: DataFrame) -> DataFrame:
    """(token, key, n, fold): ``heads`` (token, key) that sets of different classes of ``root`` share, with the class as ``up`` and the head's largest one as ``main``."""
    classed = heads.join(root.select(F.col("a").alias("key"), F.col("b").alias("up")), "key", "left").withColumn("up", F.coalesce("up", "key"))
    sizes = classed.groupBy("token", "up").agg(F.count("*").alias("held"))
    mixed = sizes.groupBy("token").agg(F.count("*").alias("classes"), F.max(F.struct("held", "up"))["up"].alias("main")).filter("classes > 1").select("token", "main")
    return stage(classed.join(mixed, "token").join(points.select("key", "n", "fold"), "key"))


def fits(a: str, b: str) -> Column:
    """Whether the sizes and ``fold`` bits of the sets at both sides allow the similarity."""
    low, high = SIMILAR
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    far = sum((F.bit_count(F.col(f"fold_{a}")[i].bitwiseXOR(F.col(f"fold_{b}")[i])) for i in range(FOLD)), F.lit(0))
    return (high * F.least(n_a, n_b) >= low * F.greatest(n_a, n_b)) & ((low + high) * far <= (high - low) * (n_a + n_b))


def beside(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b: sets of different classes that are next to each other in size under a head and may be similar."""
    order = Window.partitionBy("token").orderBy("n", "key")
    names = ["up", "key", "n", "fold"]
    both = met.select("token", *[F.col(c).alias(f"{c}_a") for c in names], *[F.lag(c).over(order).alias(f"{c}_b") for c in names])
    return stage(both.filter((F.col("up_a") != F.col("up_b")) & fits("a", "b")).select(
        F.greatest("key_a", "key_b").alias("a"), F.least("key_a", "key_b").alias("b")).distinct())


def across(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b: all sets of different classes that share a head and may be similar.

    One of them is not of the head's largest class, so that class never meets itself.
    """
    small, every = (met.select("token", (F.col("up") != F.col("main")).alias(f"small_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ["up", "key", "n", "fold"]]) for side in "ab")
    meet = (F.col("up_a") != F.col("up_b")) & (~F.col("small_b") | (F.col("key_a") > F.col("key_b"))) & fits("a", "b")
    pairs = small.filter("small_a").withColumnRenamed("token", "t").join(every, (F.col("t") == F.col("token")) & meet)
    return stage(pairs.select(F.greatest("key_a", "key_b").alias("a"), F.least("key_a", "key_b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **sizes: int) -> DataFrame:
    """doc_id, (k1, k2), ``component_id`` (the least id reachable) and ``component_key`` (never null) of every row."""
    rows = stage(signatures(docs, id_col, text_col, shingle))
    points = stage(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("head"),
                                           F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("turned").alias("turned"), F.first("fold").alias("fold")))
    pairs = stage(candidates(points, **sizes))
    root = components(similar(pairs, docs, points, id_col, text_col, shingle))
    discard(pairs)
    heads = stage(prefixes(docs, rows, text_col, shingle))
    met = meeting(heads, points, root)
    discard(heads)
    for paired in (beside, across):
        pairs = paired(met)
        root = components(root.union(similar(pairs, docs, points, id_col, text_col, shingle)))
        discard(pairs)
        if paired is beside:
            met, former = meeting(met.select("token", "key"), points, root), met
            discard(former)
    discard(met)
    keyed = points.join(root.select(F.col("a").alias("key"), F.col("b").alias("up")), "key", "left").withColumn(
        "component_key", F.coalesce("up", "key"))
    ids = keyed.groupBy("component_key").agg(F.min("least").alias("component_id"))
    found = stage(keyed.select("key", "component_key").join(ids, "component_key"))
    return rows.join(found, "key").select("doc_id", "k1", "k2", "component_id", "component_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id, all columns kept."""
    return heads_of(docs, near_duplicates(docs, id_col, text_col, shingle), id_col, text_col)
