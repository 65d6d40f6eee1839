"""Approximate nearest neighbours with one small-world graph per shard (operator 5).

Equal vectors are one point. Points are dealt to shards by hash; each shard builds a
hierarchical navigable small-world graph and stores it as flat arrays: vectors, the
levels, and for every level a table of neighbour numbers. Query blocks are dealt to all
shards, each answers with its nearest points, and the answers are merged. Points stand
for all their vectors again when ranks are given, smaller ids first.

Ties go to the point with the smallest id: a search widens until it has seen all points as
far as its last one, and sums distances in the order of the components, as the score does.

Vectors that are null, all zero, or hold null or non-finite components take no part. Vectors
of different lengths have no distance; each length is searched by itself. Every row is a row
of its own: a query's own row is no candidate, rows that repeat its vector or its id are. A
null id asks nothing and comes last in ties. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from parley.llm.common import prepare
from parley.session import stage

K = 10
#: Links per point (twice that on the ground level), candidates kept while building and searching.
LINKS, BUILD, SEARCH = 16, 96, 128
SHARD_POINTS = 4_096
QUERY_BLOCK = 512
SEED = 7

INDEX = "dim int, shard long, n int, entry int, vectors binary, least binary, top binary, ground binary, upper_at binary, upper binary"
#: What stands for a null id in ties.
LAST = np.iinfo(np.int64).max


class Graph:
    """Flat arrays: vectors (n, dim), the smallest id of each, ground (n, 3*LINKS), upper rows of LINKS from ``upper_at[i]`` on, -1 for none."""

    def __init__(self, vectors: np.ndarray, least: np.ndarray | None = None, links: int = LINKS, build: int = BUILD) -> None:
        self.v, self.links, self.build = vectors, links, build
        n = len(vectors)
        self.least = np.arange(n, dtype=np.int64) if least is None else least
        draw = np.random.default_rng(SEED).random(n)
        self.top = np.minimum((-np.log(1.0 - draw) / np.log(links)).astype(np.int32), 12)
        self.upper_at = np.concatenate([[0], np.cumsum(self.top)[:-1]]).astype(np.int32) if n else np.zeros(0, np.int32)
        self.ground = np.full((n, 3 * links), -1, np.int32)
        self.upper = np.full((int(self.top.sum()), links), -1, np.int32)
        self.used = [np.zeros(n, np.int32), np.zeros(len(self.upper), np.int32)]
        self.entry = 0
        self._mark, self._round = np.zeros(n, np.int64), 0
        for i in range(1, n):
            self._insert(i)
        self._join_up()

    @classmethod
    def stored(cls, row) -> Graph:
        g = cls.__new__(cls)
        n, links = row.n, LINKS
        g.v = np.frombuffer(row.vectors, np.float64).reshape(n, row.dim)
        g.least = np.frombuffer(row.least, np.int64)
        g.top, g.upper_at = np.frombuffer(row.top, np.int32), np.frombuffer(row.upper_at, np.int32)
        g.ground = np.frombuffer(row.ground, np.int32).reshape(n, -1)
        g.upper = np.frombuffer(row.upper, np.int32).reshape(-1, links)
        g.links, g.entry, g._mark, g._round = links, row.entry, np.zeros(n, np.int64), 0
        return g

    def _row(self, i: int, level: int) -> tuple[np.ndarray, int, int]:
        return (self.ground, 0, i) if level == 0 else (self.upper, 1, self.upper_at[i] + level - 1)

    def neighbours(self, i: int, level: int) -> np.ndarray:
        table, _, at = self._row(i, level)
        row = table[at]
        return row[row >= 0]

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.v[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def layer(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest points met in a best-first walk, as (squared distance, point)."""
        self._round += 1
        mark, now = self._mark, self._round
        for _, i in start:
            mark[i] = now
        todo, best = sorted(start), [(-d, -i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = self.neighbours(i, level)
            near = near[mark[near] != now]
            if not len(near):
                continue
            mark[near] = now
            dist = self.distances(q, near)
            if len(best) >= ef:
                close = dist < -best[0][0]
                near, dist = near[close], dist[close]
            for x, j in zip(dist.tolist(), near.tolist()):
                if len(best) < ef or x < -best[0][0]:
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(best, (-x, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def _descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.distances(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.top[self.entry]), to, -1):
            at = self.layer(q, at, 1, level)
        return at

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Points closer to the new one than to those chosen before, filled up with the nearest."""
        ids = np.array([i for _, i in found])
        if len(ids) <= m:
            return ids.tolist()
        own, v = np.array([d for d, _ in found]), self.v[ids]
        norm = np.einsum("ij,ij->i", v, v)
        between = norm[:, None] + norm[None, :] - 2.0 * (v @ v.T)
        nearest = np.full(len(ids), np.inf)
        chosen, left = [], []
        for x in range(len(ids)):
            if len(chosen) == m:
                break
            if own[x] < nearest[x]:
                chosen.append(x)
                np.minimum(nearest, between[x], out=nearest)
            else:
                left.append(x)
        return ids[(chosen + left)[:m]].tolist()

    def _insert(self, i: int) -> None:
        q, level = self.v[i], int(self.top[i])
        highest = int(self.top[self.entry])
        at = self._descend(q, min(level, highest))
        for lv in range(min(level, highest), -1, -1):
            at = self.layer(q, at, self.build, lv)
            for j in self._choose(at, self.links):
                self._link(i, j, lv)
                self._link(j, i, lv)
        if level > highest:
            self.entry = i

    def _link(self, i: int, j: int, level: int) -> None:
        table, kind, at = self._row(i, level)
        used = self.used[kind]
        if used[at] == table.shape[1]:
            ids = np.append(table[at], j)
            found = sorted(zip(self.distances(self.v[i], ids).tolist(), ids.tolist()))
            keep = self._choose(found, 2 * self.links if level == 0 else self.links)
            table[at] = -1
            table[at, : len(keep)] = keep
            used[at] = len(keep)
        else:
            table[at, used[at]] = j
            used[at] += 1

    def _join_up(self) -> None:
        """Links on the ground level to points that no walk from the entry reaches."""
        seen, extra = np.zeros(len(self.v), bool), {}

        def walk(todo: list[int]) -> None:
            while todo:
                near = self.neighbours(todo.pop(), 0)
                near = near[~seen[near]]
                seen[near] = True
                todo += near.tolist()

        for i in [self.entry, *range(len(self.v))] if len(self.v) else []:
            if not seen[i]:
                seen[i] = True
                if i != self.entry:
                    near = [j for j in self.neighbours(i, 0).tolist() if seen[j]] or [self.entry]
                    extra.setdefault(min(near, key=lambda j: len(extra.get(j, ()))), []).append(i)
                walk([i])
        if extra:
            wide = np.full((len(self.v), max(map(len, extra.values()))), -1, np.int32)
            for j, more in extra.items():
                wide[j, :len(more)] = more
            self.ground = np.concatenate([self.ground, wide], axis=1)

    def search(self, q: np.ndarray, k: int, ef: int = SEARCH) -> list[tuple[float, int]]:
        """The k nearest points found, as (distance, point); of equally far ones those of the smallest ids."""
        start, ef = self._descend(q, 0), max(ef, k)
        if start[0][1] != self.entry:  # from where every point can be reached
            start.append((float(self.distances(q, np.array([self.entry]))[0]), self.entry))
        while True:
            found = self.layer(q, start, ef, 0)
            # a hair above the k-th, as sums in another order differ in the last digit
            if len(found) < ef or found[-1][0] > found[k - 1][0] * (1.0 + 1e-9):
                break
            ef *= 2
        ids = np.array([i for _, i in found], np.int64)
        score = np.sqrt(np.cumsum(np.square(self.v[ids] - q), axis=1)[:, -1])
        order = np.lexsort((self.least[ids], score))[:k]
        return [(float(score[i]), int(ids[i])) for i in order]


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and ``v`` of doubles, only rows that take part; -0.0 is 0.0."""
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0.0))


def build_index(points: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row of flat arrays per length and shard, written to the shared folder; ``points`` has distinct ``v`` and their ``least`` ids."""
    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(v=[tuple(x) for x in group["v"]]).sort_values("v")
        g = Graph(np.array(group["v"].tolist(), np.float64), group["least"].to_numpy(np.int64))
        raw = [x.tobytes() for x in (g.v, g.least, g.top, g.ground, g.upper_at, g.upper)]
        return pd.DataFrame([[int(group["dim"].iloc[0]), int(group["shard"].iloc[0]), len(g.v), g.entry, *raw]], columns=[c.split()[0] for c in INDEX.split(", ")])

    sized = points.withColumn("dim", F.size("v"))
    shards = stage(sized.groupBy("dim").agg(F.ceil(F.count("*") / float(shard_points)).cast("long").alias("shards")))
    dealt = sized.join(shards, "dim").select("dim", F.pmod(F.xxhash64("v"), "shards").alias("shard"), "v", "least")
    # few bytes, much work: a task for about every shard, not one for as many as fit
    dealt = dealt.repartition(shards.agg(F.sum("shards")).first()[0] or 1, "dim", "shard")
    return stage(dealt.groupBy("dim", "shard").applyInPandas(build, INDEX))


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = SEARCH) -> DataFrame:
    """(query, v, d, least): for every query (query, q) the k nearest points of each shard of its length."""
    blocks = F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))
    asked = queries.groupBy(F.size("q").alias("dim"), F.pmod(F.xxhash64("query"), blocks).alias("block")).agg(F.collect_list(F.struct("query", "q")).alias("queries"))
    work = asked.join(index, "dim").drop("block").repartition(max(1, index.count()), "dim", "shard")

    def answer(batches):
        held, graph = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                if (row.dim, row.shard) != held:
                    held, graph = (row.dim, row.shard), Graph.stored(row)
                for ask in row.queries:
                    for d, i in graph.search(np.array(ask["q"], np.float64), k, ef):
                        out.append((ask["query"], graph.v[i].tolist(), d, int(graph.least[i])))
            yield pd.DataFrame(out, columns=["query", "v", "d", "least"])

    return work.mapInPandas(answer, "query bigint, v array<double>, d double, least bigint")


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_points: int = SHARD_POINTS, ef: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows by Euclidean distance.

    ``is_query`` tells from ``vec_id`` which rows ask.
    """
    prepare(vectors.sparkSession)
    rows = stage(valid(vectors, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()))
    queries = rows.filter(is_query).select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    points = stage(rows.groupBy("v").agg(F.min(F.coalesce("vec_id", F.lit(LAST))).alias("least")))
    found = search(build_index(points, shard_points), queries.select("query", "q"), k + 1, ef)
    # of equal vectors a query needs no more than the k + 1 smallest ids
    by_id = [F.col("vec_id").asc_nulls_last(), "key"]
    place = Window.partitionBy("v").orderBy(*by_id)
    ids = rows.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1).select("key", "vec_id", "v")
    near = Window.partitionBy("query").orderBy("d", "least", "v")
    best = found.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k + 1)
    pairs = stage(best.select("query", "v")).join(ids, "v").filter("key <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", *by_id))
    scored = pairs.join(queries, "query").withColumn(
        "score", F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
