"""Language-model scores from a log-frequency Bloom filter (operator 10).

A count c is kept as its level 1 + floor(log c) on a coarse base. The filter holds an
n-gram once for each level up to its own, and a reader probes level after level until
one is missing, so a count is never read too low and rarely too high. Probabilities are
bigrams smoothed by unigrams, both from probes.

N-grams are counted over all training texts: tasks hash and pre-add them, one shuffle
brings equal hashes together by segment of the hash range, and a task, which meets its
segments in order and holds one at a time, adds the counts and writes that part of the
filter, sized to what it holds. Nothing is pruned. Filters are sent to workers in passes
of at most ``max_mb``: a share of the bigrams, and the unigrams, or where those exceed
half of it, one share of them for the word before and one for the word itself. Partial
sums of the passes are added per text.

Null and empty texts are one end token. A null id trains and is not held out. Repeated
rows train and score each by itself. Tables without training texts score 0 per token.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import picked, prepare
from parley.session import stage

BASE = 1.5
PROBES = 3
BITS_PER_ENTRY = 8
SMOOTHING = 200.0
#: Bytes of text per segment of the hash range, tokens a task adds up before it sends counts, megabytes of filter in a pass.
SEGMENT_BYTES = 4 << 20
#: Segments a task sorts, about; beyond that many tasks each gets more, and sorts them on disk.
TASK_SEGMENTS, MOST_TASKS = 4, 100_000
FLUSH_TOKENS = 1_500_000
MAX_MB = 512
REMEMBERED = 300_000

#: The end token, which also stands before a text's first word. No word holds a blank.
END = b"\n"

_U = np.uint64
_A, _B, _C, _D = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count)), exact at the borders."""
    borders = BASE ** np.arange(1, 110)
    return 1 + np.searchsorted(borders, counts, "right")


#: What a level stands for: the mean of the counts on it.
MEANS = np.array([0.0] + [(np.ceil(BASE ** (q - 1)) + np.ceil(BASE**q) - 1) / 2 for q in range(1, 111)])


def positions(hashes: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """(PROBES, n) bit numbers for a level; ``bits`` is the length of each hash's segment."""
    first = mixed(hashes + _U(level * int(_A) % 2**64))
    second = mixed(hashes ^ _U(level * int(_D) % 2**64)) | _U(1)
    return np.stack([(first + _U(i) * second) % bits for i in range(PROBES)])


class Filter:
    """Segments of one log-frequency Bloom filter, side by side; a segment of 0 bits is absent."""

    def __init__(self, segments: dict[int, np.ndarray], shift: int) -> None:
        n = max([1, *(k + 1 for k in segments)])
        self.bits, self.at, self.shift = np.zeros(n, np.uint64), np.zeros(n, np.int64), shift
        at = 0
        for k in sorted(segments):
            self.bits[k], self.at[k] = 8 * len(segments[k]), at
            at += len(segments[k])
        self.data = np.concatenate([segments[k] for k in sorted(segments)]) if segments else np.zeros(0, np.uint8)

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum((hashes >> _U(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(hashes), np.int64), len(self.bits) - 1)

    def here(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes belong to a segment this filter holds."""
        raw = (hashes >> _U(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(hashes), np.int64)
        return (raw < len(self.bits)) & (self.bits[np.minimum(raw, len(self.bits) - 1)] > 0)

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The mean count of each hash's highest level found; 0 where the first is missing."""
        out = np.zeros(len(hashes))
        left = np.nonzero(self.here(hashes))[0]
        level = 1
        while len(left):
            h = hashes[left]
            seg = self.segment(h)
            found = np.ones(len(left), bool)
            for p in positions(h, level, self.bits[seg]):
                byte = self.data[self.at[seg] + (p >> _U(3)).astype(np.int64)]
                found &= (byte >> (p & _U(7)).astype(np.uint8)) & 1 > 0
            left = left[found]
            out[left] = MEANS[level]
            level += 1
        return out


def filter_segment(hashes: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The bytes of a segment that holds these n-grams."""
    level = levels(counts)
    entries = int(level.sum())
    data = np.zeros(8 * max(1, -(-entries * bits_per_entry // 64)), np.uint8)
    bits = np.array(8 * len(data), np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        p = positions(hashes[level >= q], q, bits).ravel()
        np.bitwise_or.at(data, (p >> _U(3)).astype(np.int64), _U(1).astype(np.uint8) << (p & _U(7)).astype(np.uint8))
    return data


class Hasher:
    """Token hashes of texts, words remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.end = xxhash.xxh64_intdigest(END)

    def __call__(self, text: bytes | None) -> list[int]:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in (text or b"").lower().split():  # bytes: A-Z only, and only the six blanks
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        out.append(self.end)
        return out


def bigrams(tokens: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """A hash for each token with the one before it; ``starts`` are the texts' first tokens."""
    before = np.concatenate([[_U(end)], tokens[:-1]]).astype(np.uint64)
    before[starts] = end
    return mixed(before * _A + mixed(tokens))


def added(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their total counts."""
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], counts[order]
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _counting(shift: int):
    def count(batches):
        hasher, held, starts, n = Hasher(), [], [], 0

        def flush():
            tokens = np.concatenate(held)
            for order, h in ((1, tokens), (2, bigrams(tokens, np.array(starts), hasher.end))):
                h, c = added(h)
                part = (h >> _U(shift)).astype(np.int64) | order << 32
                for at in range(0, len(h), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[cut]), pa.array(h[cut].view(np.int64)), pa.array(c[cut].astype(np.int32))], ["part", "hash", "count"])

        for b in batches:
            for text in b.column("text").to_pylist():
                tokens = np.array(hasher(text), np.uint64)
                held.append(tokens)
                starts.append(n)
                n += len(tokens)
                if n >= FLUSH_TOKENS:
                    yield from flush()
                    held, starts, n = [], [], 0
        if n:
            yield from flush()
    return count


def _building(bits_per_entry: int):
    """Adds up each segment's counts and writes its filter; for unigrams the exact counts too. Rows come sorted by part."""
    def built(part: int, pieces: list) -> pa.RecordBatch:
        n, seg = part >> 32, part & 0xFFFFFFFF
        h, c = added(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]).astype(np.int64))
        exact = (h.tobytes(), c.tobytes()) if n == 1 else (None, None)
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int8()), pa.array([seg], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64()),
             pa.array([filter_segment(h, c, bits_per_entry).tobytes()], pa.binary()), pa.array([exact[0]], pa.binary()), pa.array([exact[1]], pa.binary())],
            ["n", "segment", "distinct", "total", "filter", "hashes", "counts"])

    def build(batches):
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            part, h, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("part", "hash", "count"))
            starts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0].tolist()
            for at, end in zip(starts, [*starts[1:], len(part)]):
                if held and part[at] != now:
                    yield built(now, held)
                    held = []
                now = int(part[at])
                held.append((h[at:end].view(np.uint64).copy(), c[at:end].copy()))
        if held:
            yield built(now, held)
    return build


MODEL = "n tinyint, segment int, distinct bigint, total bigint, filter binary, hashes binary, counts binary"


class Model(NamedTuple):
    """The written segments, and what all scores need: how hashes are cut, N and V."""

    segments: DataFrame
    shift: int
    tokens: int
    types: int


def train(texts: DataFrame, text_col: str = "text", bits_per_entry: int = BITS_PER_ENTRY) -> Model:
    """Counts all unigrams and bigrams of ``texts`` and builds the filter's segments."""
    prepare(texts.sparkSession)
    bare = picked(texts, text=text_col).withColumn("text", F.col("text").cast("binary"))
    size = bare.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 << max(4, (size // SEGMENT_BYTES).bit_length())
    shift = 64 - (segments.bit_length() - 1)
    counted = bare.mapInArrow(_counting(shift), "part bigint, hash bigint, count int")
    tasks = min(MOST_TASKS, max(1, 2 * segments // TASK_SEGMENTS))
    made = stage(counted.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_building(bits_per_entry), MODEL))
    seen = made.filter("n = 1").agg(F.sum("total"), F.sum("distinct")).first()
    return Model(made, shift, seen[0] or 0, seen[1] or 0)


def _loaded(rows, shift: int) -> Filter:
    return Filter({r.segment: np.frombuffer(r.filter, np.uint8) for r in rows}, shift)


def passes(model: Model, max_mb: int) -> tuple[int, int]:
    """Shares into which bigrams with the exact counts, and unigrams, are cut so that a pass stays within ``max_mb``.

    Either gets half of it; unigrams that exceed theirs are cut so that two shares fit.
    """
    exact = F.octet_length("hashes") + F.octet_length("counts")
    sizes = model.segments.agg(
        F.sum(F.when(F.col("n") == 1, F.octet_length("filter"))), F.sum(F.when(F.col("n") == 1, exact).otherwise(F.octet_length("filter")))).first()
    unigrams, rest, half = sizes[0] or 0, sizes[1] or 0, max_mb << 19
    return max(1, -(-rest // half)), 1 if unigrams <= half else -(-2 * unigrams // half)


def _scoring(shared, share: int, of: int, before_in: int, own_in: int, cuts: int, shift: int, total: int, types: int, smoothing: float):
    """Scores of whole texts, only with the tokens and bigrams of one pass.

    A bigram belongs to the pass that has its share and both of its words' shares; an
    exact count to the pass that has its share and the first of the others.
    """
    def within(h: np.ndarray, part: int, parts: int) -> np.ndarray:
        return (h >> _U(shift)).astype(np.int64) % parts == part

    first = before_in == own_in == 0

    def score(batches):
        unigram, bigram, known, exact = shared.value
        hasher = Hasher()
        scale = np.log10(total + types + 1.0)
        for b in batches:
            if not b.num_rows:
                continue
            per = [np.array(hasher(t), np.uint64) for t in b.column("text").to_pylist()]
            lengths = np.array([len(t) for t in per], np.int64)
            tokens = np.concatenate(per)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            types_here, which = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(known, types_here), max(len(known) - 1, 0))
            hit = known[at] == types_here if len(known) else np.zeros(len(types_here), bool)
            c = np.where(hit, exact[at] if len(known) else 0, 0)
            base = np.where(within(types_here, share, of) & first, np.log10(c + 1.0) - scale, 0.0)
            rough = unigram.counts(types_here)
            pairs, pair_of = np.unique(bigrams(tokens, starts, hasher.end), return_inverse=True)
            held, together = within(pairs, share, of), bigram.counts(pairs)
            before = np.concatenate([[0], which[:-1]])
            before[starts] = np.searchsorted(types_here, _U(hasher.end))
            mine = held[pair_of] & within(types_here, before_in, cuts)[before] & within(types_here, own_in, cuts)[which]
            context, own = rough[before], (rough[which] + 1.0) / (total + types + 1.0)
            p = (np.minimum(together[pair_of], context) + smoothing * own) / (context + smoothing)
            part = np.where(mine, np.log10(np.minimum(p, 1.0)), 0.0)
            sums = [np.add.reduceat(x, starts) for x in ((c > 0)[which].astype(np.int64), base[which], part)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in ("doc_id", "held_out", "k1", "k2")), pa.array(lengths), *map(pa.array, sums)],
                ["doc_id", "held_out", "k1", "k2", "n_tokens", "n_known", "base_score", "score"])

    return score


def score(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          smoothing: float = SMOOTHING, max_mb: int = MAX_MB) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score adds one to exact unigram counts; score is log10 of the smoothed bigram
    probability of the tokens, from the filter.
    """
    spark = prepare(docs.sparkSession)
    held = F.lit(False) if held_out is None else held_out
    rows = picked(docs, doc_id=id_col, text=text_col).withColumn("held_out", F.coalesce(held, F.lit(False)))
    rows = rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("second"), "text", "doc_id"), "text": F.col("text").cast("binary")})
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, k1 bigint, k2 bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    of, cuts = passes(model, max_mb)
    n_passes, parts = of * cuts * cuts, []
    for before_in, own_in, share in product(range(cuts), range(cuts), range(of)):
        if share == 0:
            words = model.segments.filter((F.col("n") == 1) & (F.col("segment") % cuts).isin(before_in, own_in))
            unigram = _loaded(words.select("segment", "filter").toLocalIterator(), model.shift)
        mine = model.segments.filter(F.col("segment") % of == share)
        bigram = _loaded(mine.filter("n = 2").select("segment", "filter").toLocalIterator(), model.shift)
        counted = mine.filter("n = 1").filter(F.lit(before_in == own_in == 0)).select("segment", "hashes", "counts")
        exact = sorted((r.segment, r.hashes, r.counts) for r in counted.toLocalIterator())
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for _, h, _ in exact)])
        times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c, np.int64) for _, _, c in exact)])
        shared = spark.sparkContext.broadcast((unigram, bigram, known, times))
        part = rows.mapInArrow(_scoring(shared, share, of, before_in, own_in, cuts, model.shift, model.tokens, model.types, smoothing), schema)
        if n_passes > 1:  # written, so that just one pass's filter is held at a time
            part = stage(part)
            shared.destroy()
        parts.append(part)
    out = parts[0]
    if n_passes > 1:
        for part in parts[1:]:
            out = out.unionAll(part)
        # a row comes once from every pass; equal rows come with equal parts
        out = out.groupBy("k1", "k2", "doc_id", "held_out", "n_tokens").agg(
            (F.count("*") / n_passes).cast("int").alias("copies"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
        out = out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
                         *[(F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")],
                         F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
