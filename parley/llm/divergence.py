"""Source divergence audit: how the sources of a language differ in their terms (operator 11).

Chunk factorization. Texts are cut at ASCII white space, and the documents of each chunk are
counted per language; a task adds its documents up before anything is shuffled. Each globally
distinct chunk is tokenized once, and its terms are joined back: to the document counts, and then
to the occurrences per source, of which only chunks of kept terms are shuffled. White space is part
of no term, so nothing is lost.

A language keeps the terms that occur in at least ``min_docs`` of its documents. A document
may hold a term in several chunks ("The", "the,"), so the documents of a term number at least
those of its most frequent chunk and at most the sum over its chunks. Where these two bounds
leave doubt, and only there, documents are told apart by their numbers, fewer than ``min_docs``
to a chunk. These and the occurrences come from one more scan, behind bit filters of fixed size
and in front of an exact join.

Null text, lang and source count as "". Every row is a document, repeated rows and null ids too.
Texts without terms, empty ones too, make their (lang, source) group occur. Very long texts are
counted whole. Ties in rank go by item in UTF-8 order. An empty table gives no rows; extra
columns are not read. Counts and smoothed shares are exact integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.llm.common import picked, prepare
from parley.session import stage

#: Fixed values of the audit: the term pattern, the least documents of a term, the smoothing, the unit of a share.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SMOOTH, UNIT = 30, 5, 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text whose chunks a task counts at once; a single text may be longer.
TEXT_BYTES = 32 << 20
#: Rows handed on at once.
OUT_ROWS = 1 << 16
#: Bits of the filter in front of the exact join, as a power of two: 4 MB whatever the input.
FILTER_BITS = 25
#: Terms a task compares at a time, and sources in a block of them.
TERMS_AT_ONCE, SOURCE_BLOCK = 4_096, 256
#: Rows (language, source, term) meant for one task.
TASK_ROWS = 50_000

_SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("excess", pa.int64())])


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = picked(docs, lang=lang_col, source=source_col, text=text_col)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and chunk number of every chunk of a batch, and the distinct chunks."""
    lists = pc.ascii_split_whitespace(batch.column("text"))
    words = pc.list_flatten(lists).dictionary_encode()
    row, code = pc.list_parent_indices(lists).to_numpy(), words.indices.to_numpy()
    blank = pc.index(words.dictionary, "").as_py()  # beside white space at either end
    full = code != blank
    return row[full].astype(np.int64), code[full].astype(np.int64), words.dictionary


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task as few, of about ``TEXT_BYTES``."""
    held, size = [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.column("text").nbytes
        if size >= TEXT_BYTES:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, max(len(part), 1), OUT_ROWS):
            yield part.slice(at, OUT_ROWS)


def _document_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, chunk, docs): documents of each chunk among the rows counted at once."""
    row, code, chunks = _encoded(batch)
    lang, n = batch.column("lang").dictionary_encode(), max(len(chunks), 1)
    once = _distinct(row * n + code)
    key, docs = np.unique(lang.indices.to_numpy().astype(np.int64)[once // n] * n + once % n, return_counts=True)
    return pa.record_batch([lang.dictionary.take(pa.array(key // n)), chunks.take(pa.array(key % n)), pa.array(docs, pa.int64())], names=["lang", "chunk", "docs"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _sliced(map(_document_batch, _gathered(batches)))


def chunk_terms(rows: DataFrame) -> DataFrame:
    """(chunk, langs, terms): every distinct chunk once, its documents per language and its terms with repeats."""
    made = rows.mapInArrow(_documents, "lang string, chunk string, docs long")
    # rows of a chunk meet in one task, where languages and then the chunk are summed up without another exchange
    per_lang = made.repartition("chunk").groupBy("lang", "chunk").agg(F.sum("docs").alias("docs"))
    found = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return per_lang.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs")).select("chunk", "langs", found.alias("terms")).filter(F.size("terms") > 0)


class BitFilter:
    """A set of chunks as bits of their hashes: may hold more, never less, in memory of fixed size."""

    def __init__(self, chunks: DataFrame) -> None:
        h = F.crc32("chunk").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # bits are numbered from 1
        blocks = chunks.groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))
        # at most 2^FILTER_BITS / 8 bytes, whatever the number of chunks
        self.bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for bucket, block in blocks.collect():
            self.bits[(bucket - 1) * len(block):bucket * len(block)] = np.frombuffer(bytes(block), np.uint8)

    @staticmethod
    def places(chunks: pa.Array) -> np.ndarray:
        return np.fromiter(map(crc32, chunks.cast(pa.binary()).to_pylist()), np.int64, len(chunks)) & ((1 << FILTER_BITS) - 1)

    def passing(self, places: np.ndarray) -> np.ndarray:
        """Whether each of the chunks at these places is in the filter."""
        return self.bits[places >> 3] >> (places & 7) & 1 == 1


def _filter(chunks: DataFrame) -> Broadcast:
    return chunks.sparkSession.sparkContext.broadcast(BitFilter(chunks))


_SEEN = "lang string, chunk string, groups array<struct<source: string, n: long>>, docs array<long>"


def _counts(likely: Broadcast, doubtful: Broadcast):
    """(lang, chunk, groups, docs): occurrences per source of the chunks in the first filter, and the
    numbers of the documents that hold those in the second."""
    def count(first: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        row, code, chunks = _encoded(batch)
        places, n, rows = BitFilter.places(chunks), max(len(chunks), 1), max(len(batch), 1)
        own = likely.value.passing(places)[code]
        row, code = row[own], code[own]
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        m = max(len(source.dictionary), 1)
        pair = lang.indices.to_numpy().astype(np.int64)[row] * n + code
        key, counts = np.unique(pair * m + source.indices.to_numpy()[row], return_counts=True)
        starts = np.flatnonzero(np.diff(key // m, prepend=-1))
        heads = key[starts] // m
        groups = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.StructArray.from_arrays(
            [source.dictionary.take(pa.array(key % m)), pa.array(counts, pa.int64())], names=["source", "n"]))
        odd = doubtful.value.passing(places)[code]
        apart = _distinct(pair[odd] * rows + row[odd])
        ends = np.append(np.searchsorted(apart // rows, heads), len(apart))
        docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first + apart % rows, pa.int64()))
        return pa.record_batch([lang.dictionary.take(pa.array(heads // n)), chunks.take(pa.array(heads % n)), groups, docs], names=["lang", "chunk", "groups", "docs"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40  # rows are numbered within this scan
        for batch in _gathered(batches):
            yield from _sliced(iter([count(first, batch)]))
            first += len(batch)
    return scan


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n): occurrences of the terms each language keeps."""
    rows = _read(docs, text_col, lang_col, source_col)
    chunks = stage(chunk_terms(rows.select("lang", "text")))
    each = chunks.select("chunk", "terms", F.inline("langs")).select("chunk", "terms", "lang", "docs", F.explode(F.array_distinct("terms")).alias("term"))
    bounds = each.groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most")).filter(F.col("most") >= min_docs)
    k = F.size(F.filter("terms", lambda t: t == F.col("term")))
    likely = stage(each.join(bounds, ["lang", "term"]).select("lang", "chunk", "term", k.alias("k"), (F.col("least") < min_docs).alias("doubtful")))
    seen = rows.mapInArrow(_counts(_filter(likely), _filter(likely.filter("doubtful"))), _SEEN)
    met = seen.join(likely.hint("shuffle_hash"), ["lang", "chunk"])
    entry = lambda source, n, doc: F.struct(source.cast("string").alias("source"), n.cast("long").alias("n"), doc.cast("long").alias("doc"))
    none = F.lit(None)
    told = F.when(F.col("doubtful"), F.transform("docs", lambda d: entry(none, F.lit(0), d))).otherwise(F.array().cast("array<struct<source: string, n: long, doc: long>>"))
    entries = F.concat(F.transform("groups", lambda g: entry(g["source"], g["n"] * F.col("k"), none)), told)
    summed = stage(met.select("lang", "term", F.inline(entries)).groupBy("lang", "source", "term", "doc").agg(F.sum("n").alias("n")))
    enough = summed.filter("doc IS NOT NULL").groupBy("lang", "term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = likely.filter("NOT doubtful").select("lang", "term").distinct().unionByName(enough.select("lang", "term"))
    return stage(summed.filter("doc IS NULL").join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term in units of ``UNIT``: 64-bit where the products fit, decimals beyond."""
    def part(kind: str) -> Column:
        wide = lambda c: c.cast(kind)
        return F.call_function("div", (wide(n) + wide(F.lit(SMOOTH))) * wide(F.lit(UNIT)), wide(total) + wide(kept) * wide(F.lit(SMOOTH)))

    fits = total + kept * SMOOTH < (1 << 63) // UNIT
    return F.when(kept > 0, F.when(fits, part("long")).otherwise(part("decimal(19,0)")) + 1)


def group_sizes(counts: DataFrame, in_lang: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, total, terms, kept, nothing): occurrences and terms of a group, kept terms of its language, the share of a term it lacks."""
    kept = in_lang.groupBy("lang").agg(F.count("*").alias("kept"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    sizes = groups.join(total, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "terms", "kept"])
    return sizes.withColumn("nothing", _share(F.lit(0), F.col("total"), F.col("kept")))


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """For two blocks of sources and a share of the terms: per pair of sources, by how much their differences
    exceed those of terms that both lack. Rows without a term name the sources."""
    lang, first, second = key[0].as_py(), key[1].as_py(), key[2].as_py()
    frame = table.select(["block", "source", "term", "p"]).to_pandas()
    heads = frame[frame.term.isna()].drop_duplicates(["block", "source"]).sort_values("source")
    sides = [heads[heads.block == b] for b in (first, second)]
    base = [s.p.fillna(0).to_numpy(np.int64) for s in sides]
    at = [{name: i for i, name in enumerate(s.source)} for s in sides]
    excess = np.zeros((len(base[0]), len(base[1])), np.int64)
    nothing = np.abs(base[0][:, None] - base[1][None, :])
    rows = frame[frame.term.notna()]
    place, terms = rows.term.factorize()
    for low in range(0, len(terms), TERMS_AT_ONCE):
        own = (place >= low) & (place < low + TERMS_AT_ONCE)
        some, where, n = rows[own], place[own] - low, min(TERMS_AT_ONCE, len(terms) - low)
        dense = []
        for side, b in enumerate((first, second)):
            p, mine = np.repeat(base[side][:, None], n, 1), (some.block == b).to_numpy()
            p[some.source[mine].map(at[side]).to_numpy(np.int64), where[mine]] = some.p[mine].to_numpy(np.int64)
            dense.append(p)
        for i, row in enumerate(dense[0]):
            excess[i] += np.abs(dense[1] - row).sum(1) - n * nothing[i]
    a, b = (list(s.source) for s in sides)
    out = [(x, y, excess[i, j]) for i, x in enumerate(a) for j, y in enumerate(b) if first < second or x < y]
    return pa.table([[lang] * len(out), [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]], schema=_SUMS)


def source_distances(shares: DataFrame, sizes: DataFrame, task_rows: int = TASK_ROWS, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, a, b, value): summed difference of the shares of every two sources of a language, both ways.

    Sources come in blocks, and a task takes two blocks and a part of the terms, so it holds bounded
    rows at any number of sources. ``shares`` has (lang, source, term, p) of the terms that occur.
    """
    in_lang = sizes.groupBy("lang").agg(
        F.ceil(F.count("*") / float(source_block)).cast("long").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum("terms") / float(task_rows))).cast("long").alias("parts"))
    named = sizes.join(in_lang, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    heads = named.select("lang", "source", "block", "blocks", F.lit(None).cast("string").alias("term"), F.col("nothing").alias("p"), part)
    terms = shares.join(named.select("lang", "source", "block", "blocks", "parts"), ["lang", "source"]).select(
        "lang", "source", "block", "blocks", "term", "p", F.pmod(F.xxhash64("term"), "parts").alias("part"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("first"), F.greatest("block", other).alias("second")))
    meet = heads.unionByName(terms).select("lang", "source", "block", "term", "p", "part", F.inline(pairs))
    made = meet.groupBy("lang", "first", "second", "part").applyInArrow(_pair_sums, "lang string, a string, b string, excess long")
    summed = made.groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess"))
    of = lambda side: named.select("lang", F.col("source").alias(side), F.col("nothing").alias(f"{side}0"), "kept")
    whole = summed.join(of("a"), ["lang", "a"]).join(of("b").drop("kept"), ["lang", "b"])
    value = F.when(F.col("kept") > 0, F.col("excess") + F.col("kept") * F.abs(F.col("a0") - F.col("b0"))).otherwise(F.lit(0)).cast("long")
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return whole.withColumn("value", value).select("lang", "value", F.inline(both))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): per group its distance to the other sources of its language
    (part ``pair``) and the ``top`` terms it uses more than its language does (part ``term``)."""
    prepare(docs.sparkSession)
    counts = term_counts(docs, min_docs, text_col, lang_col, source_col)
    groups = _read(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    in_lang = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")))
    sizes = stage(group_sizes(counts, in_lang, groups))
    shares = counts.join(sizes, ["lang", "source"]).select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    pair = source_distances(shares, sizes).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    all_lang = sizes.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    usual = in_lang.join(all_lang, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    more = shares.join(usual, ["lang", "term"]).filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).filter(F.col("rank") <= top))
