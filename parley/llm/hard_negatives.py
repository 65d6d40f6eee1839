"""Hard-negative mining (operator 13): per anchor its nearest rows of the same label, and for each of
them the nearest rows of other labels whose score is close to, but not above, the positive's.

Four-Russians scoring. Components are integers. For every eight dimensions an anchor has a table of
its 256 subset sums; a candidate keeps, per bit of its components (two's complement), one byte for
every eight dimensions. The byte picks the subset sum, and the sums shifted by the bit's place add up
to the exact inner product. Candidates lie packed in shards; blocks of anchors meet a shard in one
sorted stream, the shard first, so a task holds one shard and one block of anchors.

First pass: anchors meet the shards that may hold their label and keep their best rows. Second pass:
anchors meet every shard with the bounds of their positives and keep the best rows between them.
Both merge by window, with groups cut to their first rows before the shuffle.

Rows with a null label, a null vector or a null or non-finite component take no part. Every other
row is a row of its own: with a repeated id, the other rows of that id are candidates too. A null
id is no anchor and comes last in ties. Vectors of another length than the anchor's have no score
with it. A label may hold most rows; it is cut into shards by count. Components of 2^24 or more (after
scaling) could leave 64 bits and are an error. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.llm.common import picked, prepare
from parley.session import stage

#: Fixed values of the task: scale of components, positives of an anchor, negatives of a positive, and the band in hundredths.
SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 3, 50, 95
#: Candidates meant for a shard, and how many candidates and anchors are scored at a time.
SHARD_ROWS, CANDIDATE_BLOCK, ANCHOR_BLOCK = 8_192, 4_096, 64
#: Components stay below this after scaling, so that scores stay in 64 bits.
WIDEST = 1 << 24
_NONE = -(1 << 62)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bytes [bit, group, row] of integers [row, dimension]: eight dimensions to a byte."""
    rows, dims = values.shape
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = values
    return np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)])


def subset_sums(values: np.ndarray) -> np.ndarray:
    """Tables [group, byte, anchor]: the sum of the components whose bits the byte sets."""
    anchors, dims = values.shape
    # 32 bits where no sum over a plane can leave them
    kind = np.int32 if int(np.abs(values).max(initial=0)) * dims < 1 << 31 else np.int64
    padded = np.zeros((anchors, -(-dims // 8) * 8), kind)
    padded[:, :dims] = values
    groups = padded.reshape(anchors, -1, 8).transpose(1, 2, 0)
    table = np.zeros((groups.shape[0], 256, anchors), kind)
    for d in range(8):  # bytes whose highest bit is d: the byte without it, plus the component
        table[:, 1 << d:2 << d] = table[:, :1 << d] + groups[:, d:d + 1]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products [candidate, anchor]; the highest plane is the sign's."""
    total = np.zeros((planes.shape[2], table.shape[2]), np.int64)
    for b, plane in enumerate(planes):
        part = np.zeros(total.shape, table.dtype)
        for sums, picks in zip(table, plane):
            part += sums[picks]
        total += part.astype(np.int64) * (-(1 << b) if b == len(planes) - 1 else 1 << b)
    return total


Best = tuple[np.ndarray, np.ndarray]


def first_best(score: np.ndarray, k: int) -> Best:
    """Places and scores [k, anchor] of the highest scores of a column, the first row first in ties; uses ``score`` up."""
    every, at, best = np.arange(score.shape[1]), [], []
    for _ in range(min(k, len(score))):
        top = score.argmax(0)
        at.append(top)
        best.append(score[top, every])
        score[top, every] = _NONE
    return np.array(at, np.int64).reshape(-1, len(every)), np.array(best, np.int64).reshape(-1, len(every))


def merged(old: Best | None, new: Best, low: int, k: int) -> Best:
    """The best of rows before ``low`` and of a block that begins there."""
    at, best = new[0] + low, new[1]
    if old is not None:
        at, best = np.concatenate([old[0], at]), np.concatenate([old[1], best])
    order = np.argsort(-best, axis=0, kind="stable")[:k]
    return np.take_along_axis(at, order, 0), np.take_along_axis(best, order, 0)


def _vectors(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each vector length, with their vectors as a matrix."""
    lengths = pc.list_value_length(rows["vector"]).to_numpy()
    for dims in np.unique(lengths):
        own = rows.take(np.flatnonzero(lengths == dims))
        flat = pc.list_flatten(own["vector"]).to_numpy().astype(np.int64)
        yield own, flat.reshape(len(own), dims)


class Shard:
    """Packed candidates of one vector length, in the order of ties."""

    def __init__(self, rows: pa.Table, values: np.ndarray) -> None:
        self.key, self.id, self.no_id, self.label = (rows[c].to_numpy() for c in ("key", "vec_id", "no_id", "code"))
        order = np.lexsort((self.key, self.id, self.no_id))
        self.key, self.id, self.no_id, self.label = self.key[order], self.id[order], self.no_id[order], self.label[order]
        widest = max(int(values.max(initial=0)), -1 - int(values.min(initial=0)))
        self.planes = bit_planes(values[order], widest.bit_length() + 1)

    def near(self, anchors: pa.Table, values: np.ndarray, k: int) -> Iterator[dict]:
        """The ``k`` best other rows of the same label; ``anchors`` share one."""
        own = np.flatnonzero(self.label == anchors["code"][0].as_py())
        key, table, best = anchors["key"].to_numpy(), subset_sums(values), None
        for low in range(0, len(own), CANDIDATE_BLOCK):
            block = own[low:low + CANDIDATE_BLOCK]
            score = scores(table, self.planes[:, :, block])
            score[self.key[block][:, None] == key[None, :]] = _NONE
            best = merged(best, first_best(score, k), low, k)
        if best is not None:
            yield from self._rows(anchors, own[best[0]], best[1], {})

    def between(self, anchors: pa.Table, values: np.ndarray, k: int) -> Iterator[dict]:
        """For each positive of each anchor the ``k`` best rows of other labels inside its bounds."""
        table, label, held = subset_sums(values), anchors["code"].to_numpy(), anchors["positives"].to_pylist()
        most = max(map(len, held), default=0)
        least, top = (np.array([[p[i][side] if i < len(p) else 0 for p in held] for i in range(most)], np.int64) for side in ("least", "most"))
        real = np.array([[i < len(p) for p in held] for i in range(most)], bool)
        best: list[Best | None] = [None] * most
        for low in range(0, len(self.key), CANDIDATE_BLOCK):
            block = slice(low, low + CANDIDATE_BLOCK)
            score = scores(table, self.planes[:, :, block])
            other = self.label[block][:, None] != label[None, :]
            for i in range(most):
                fits = other & real[i] & (score >= least[i]) & (score <= top[i])
                best[i] = merged(best[i], first_best(np.where(fits, score, _NONE), k), low, k)
        for i, found in enumerate(best):
            if found is not None:
                yield from self._rows(anchors, found[0], found[1], {"place": i})

    def _rows(self, anchors: pa.Table, at: np.ndarray, score: np.ndarray, more: dict) -> Iterator[dict]:
        kept = score > _NONE
        n, a = np.nonzero(kept)
        if len(a):
            places, names = at[n, a], anchors["key"].to_numpy()
            yield {"anchor": names[a], "key": self.key[places], "vec_id": self.id[places], "no_id": self.no_id[places], "score": score[n, a],
                   "place": np.full(len(a), more.get("place", 0), np.int32)}


_FOUND = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("no_id", pa.bool_()), ("score", pa.int64()), ("place", pa.int32())])
_FOUND_SQL = "anchor long, key long, vec_id long, no_id boolean, score long, place int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.Table]]:
    """(shard, are anchors, rows) of a sorted stream: a shard's candidates whole, its anchors in blocks."""
    held, mark = [], None

    def whole():
        return mark[0], mark[1], pa.Table.from_batches(held)

    for batch in batches:
        marks = np.stack([batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)], 1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
        for a, b in zip(cuts, cuts[1:]):
            for low in range(a, b, ANCHOR_BLOCK) if marks[a, 1] else [a] if a < b else []:
                now = (int(marks[a, 0]), bool(marks[a, 1]))
                if mark is not None and (now != mark or now[1] and sum(map(len, held)) + min(b - low, ANCHOR_BLOCK) > ANCHOR_BLOCK):
                    yield whole()
                    held = []
                mark = now
                held.append(batch.slice(low, min(b - low, ANCHOR_BLOCK) if now[1] else b - a))
    if held:
        yield whole()


def _meeting(find, k: int):
    """Anchors against the shard that comes before them in the stream."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shards = None, {}
        for number, asks, rows in _runs(batches):
            if not asks:
                at, shards = number, {values.shape[1]: Shard(own, values) for own, values in _vectors(rows)}
            elif at == number:
                for own, values in _vectors(rows):
                    if values.shape[1] in shards:
                        for found in find(shards[values.shape[1]], own, values, k):
                            yield pa.record_batch([pa.array(found[c.name], c.type) for c in _FOUND], schema=_FOUND)
    return meet


def _by_label(shard: Shard, anchors: pa.Table, values: np.ndarray, k: int) -> Iterator[dict]:
    codes = anchors["code"].to_numpy()
    for code in np.unique(codes):
        own = np.flatnonzero(codes == code)
        yield from shard.near(anchors.take(own), values[own], k)


def _meet(candidates: DataFrame, anchors: DataFrame, shards: int, find, k: int) -> DataFrame:
    """Rows found; ``anchors`` come once per shard they ask."""
    no_positives = F.lit(None).cast(anchors.schema["positives"].dataType)
    both = candidates.select("shard", F.lit(False).alias("asks"), "key", "vec_id", "no_id", "code", "vector", no_positives.alias("positives")).unionByName(
        anchors.select("shard", F.lit(True).alias("asks"), "key", "vec_id", "no_id", "code", "vector", "positives"))
    return both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "asks", "code", "key").mapInArrow(_meeting(find, k), _FOUND_SQL)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down, as 64-bit integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))


def usable(vector: Column) -> Column:
    finite = lambda x: F.coalesce((x == x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)) & ~F.isnan(x.cast("double"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
         shard_rows: int = SHARD_ROWS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a Column over ``rows``. A negative's score lies between ``least`` and ``most`` hundredths of the positive's.
    """
    prepare(rows.sparkSession)
    read = rows.withColumn("__asks", F.coalesce(is_anchor, F.lit(False)))
    read = picked(read, vec_id=id_col, vector=vector_col, label=label_col, asks="__asks").filter(F.col("label").isNotNull() & usable(F.col("vector")))
    read = stage(read.select(F.monotonically_increasing_id().alias("key"), F.coalesce("vec_id", F.lit(0)).cast("long").alias("vec_id"),
                             F.col("vec_id").isNull().alias("no_id"), "label", "asks", whole_numbers(F.col("vector"), scale).alias("vector")))
    total, high, low = read.agg(F.count("*"), F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    if max(high or 0, -(low or 0)) >= WIDEST:
        raise OverflowError(f"a component reaches {WIDEST} after scaling")
    labels = stage(read.groupBy("label").agg(F.count("*").alias("n")).withColumn("code", F.monotonically_increasing_id()))
    shards = max(1, -(-total // shard_rows))
    first, slices = F.xxhash64("code"), F.ceil(F.col("n") / float(shard_rows))
    shard = lambda i: F.pmod(F.pmod(first, F.lit(shards)) + i, F.lit(shards))
    coded = read.join(labels, "label").drop("label")
    candidates = stage(coded.withColumn("shard", shard(F.pmod(F.xxhash64("key"), slices))))
    anchors = candidates.filter("asks").drop("shard")
    nothing = F.array().cast("array<struct<least: long, most: long>>").alias("positives")
    own = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), slices - 1), shard)).alias("shard")
    near = _meet(candidates, anchors.select("key", "vec_id", "no_id", "code", "vector", nothing, own), shards, _by_label, positives)
    order = [F.desc("score"), "no_id", "vec_id", "key"]
    best = near.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(*order))).filter(F.col("place") <= positives)
    best = stage(best.withColumn("place", F.col("place") - 1))
    # bounds in whole scores: the least at or above, and the most at or below, so many hundredths
    bounds = F.struct("place", (-F.floor(-F.col("score").cast("decimal(20,0)") * least / 100)).cast("long").alias("least"),
                      F.floor(F.col("score").cast("decimal(20,0)") * most / 100).cast("long").alias("most"))
    held = best.groupBy(F.col("anchor").alias("key")).agg(F.transform(F.array_sort(F.collect_list(bounds)), lambda b: b.dropFields("place")).alias("positives"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    asking = anchors.join(held, "key").select("key", "vec_id", "no_id", "code", "vector", "positives", every)
    found = _meet(candidates, asking, shards, Shard.between, negatives)
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(*order))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    shown = lambda df, name: df.select("anchor", "place", F.when(~F.col("no_id"), F.col("vec_id")).alias(f"{name}_id"), F.col("score").alias(f"{name}_score"),
                                       *(["rank"] if name == "negative" else []))
    ids = anchors.select(F.col("key").alias("anchor"), F.when(~F.col("no_id"), F.col("vec_id")).alias("anchor_id"))
    return shown(found, "negative").join(shown(best, "positive"), ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
