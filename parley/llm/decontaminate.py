"""Benchmark decontamination: which documents repeat benchmark items (operator 12).

The windows of all items, ``size`` consecutive words each, go into one Aho-Corasick automaton
whose letters are whole normalised words, so a match never begins or ends inside a word. Each
text is scanned once; a match ends at a word, and the places of the words lead back to
character spans of the original text.

An item of fewer words is one window, an item without words none. Null texts have no words, and
null items none. Rows with the same item id are one item; a null id is an item called "null".
Every row of the documents gives a row, repeated rows and null ids too; very long texts are read
whole. Of windows that several items share, each of the items counts. An empty benchmark hits
nothing, an empty table gives no rows. Extra columns are not read.

What a worker holds is bounded: items are dealt to automata of at most ``AUTOMATON_WORDS``
words, and a larger benchmark takes more scans, written between. An item longer than that is
cut into overlapping pieces, so that every window lies in one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import picked, prepare
from parley.session import stage

WINDOW = 10
#: Words of items in one automaton, about 3 KB of memory each at 10 words a window.
AUTOMATON_WORDS = 100_000
#: A-Z become a-z, all other ASCII but digits and a-z parts words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_STARTS = bytes(0 if c < 128 and _PLAIN[c] == 32 else 1 for c in range(256))

_STATE = "doc_id long, text string, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode().translate(_PLAIN).split()


class Automaton(NamedTuple):
    """``letters`` numbers the words of the items; ``found`` maps a window's number to its length and its items."""

    letters: dict[bytes, int]
    machine: ahocorasick.Automaton
    found: list[tuple[int, tuple[str, ...]]]

    @staticmethod
    def of(items: list[tuple[str, list[bytes]]], size: int) -> Automaton:
        letters: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], dict[str, None]] = {}
        for name, words in items:
            own = [letters.setdefault(w, len(letters) + 1) for w in words]
            for at in range(max(len(own) - size, 0) + 1):
                windows.setdefault(tuple(own[at:at + size]), {})[name] = None
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for number, window in enumerate(windows):
            machine.add_word(window, number)
        machine.make_automaton()
        return Automaton(letters, machine, [(len(w), tuple(names)) for w, names in windows.items()])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges inside windows, disjoint and in order, and the items hit."""
        letters = tuple(map(self.letters.get, words, [0] * len(words)))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if any(letters):
            for end, number in self.machine.iter(letters):
                n, own = self.found[number]
                names.update(own)
                spans.append((end + 1 - n, end + 1))
        return union(spans), names


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges as few disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where word ranges lie in the original text, in characters, end exclusive."""
    raw = text.encode()
    kind = raw.translate(_STARTS)
    # bytes 0x80 to 0xBF continue a character
    chars = list(accumulate((b & 0xC0 != 0x80 for b in raw), initial=0))
    begins, ends, before = [], [], 0
    for i, k in enumerate(kind):
        if k != before:
            (begins if k else ends).append(i)
        before = k
    if before:
        ends.append(len(raw))
    return [(chars[begins[a]], chars[ends[b - 1]]) for a, b in ranges]


#: Automata this worker has built, by broadcast; one benchmark at a time.
_BUILT: dict[str, Automaton] = {}


def _scanner(items, size: int):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton.of(items.value, size)
        machine = _BUILT[key]
        for batch in batches:
            n, starts, ends, names = [], [], [], []
            for text, a, b, old in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends", "items"))):
                words = words_of(text)
                spans, found = machine.scan(words)
                spans = union([*zip(a, b), *spans])
                n.append(len(words))
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                names.append(sorted({*old, *found}))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "starts", "ends", "items"])
    return scan


def _dealt(benchmark: DataFrame, size: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in lists of at most ``most`` words, read one partition at a time."""
    held, n = [], 0
    for row in benchmark.toLocalIterator():
        words, name = words_of(row["text"]), "null" if row["item_id"] is None else str(row["item_id"])
        step = max(most - size + 1, 1)
        for piece in [words[at:at + step + size - 1] for at in range(0, max(len(words) - size + 1, min(len(words), 1)), step)]:
            if held and n + len(piece) > most:
                yield held
                held, n = [], 0
            held.append((name, piece))
            n += len(piece)
    yield held


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, starts, ends, items): word ranges inside windows of the benchmark, and the items they are of."""
    spark = prepare(docs.sparkSession)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = picked(docs, doc_id=id_col, text=text_col).withColumns(
        {"n_words": F.lit(0).cast("long"), "starts": none("int"), "ends": none("int"), "items": none("string")})
    schema = _STATE.replace("doc_id long", f"doc_id {docs.schema[id_col].dataType.simpleString()}")
    for k, items in enumerate(_dealt(picked(benchmark, item_id=item_col, text=item_text_col), size, max(automaton_words, size))):
        # scans after the first go on from a written table, so that one automaton is held at a time
        rows = (stage(rows) if k else rows).mapInArrow(_scanner(spark.sparkContext.broadcast(items), size), schema)
    return rows


def n_hit() -> Column:
    return F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [char_spans(t or "", list(zip(a, b))) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")))]
        made = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([batch.column("doc_id"), batch.column("text"), made, batch.column("items")], names=["doc_id", "text", "spans", "items"])


def passages(found: DataFrame) -> DataFrame:
    """(doc_id, text, spans, items) of the documents hit: character spans of the original text, end exclusive."""
    kind = found.schema["doc_id"].dataType.simpleString()
    hit = found.filter(F.size("starts") > 0).select("doc_id", "text", "starts", "ends", "items")
    return hit.mapInArrow(_spans, f"doc_id {kind}, text string, spans array<struct<start: long, end: long>>, items array<string>")


def item_digest(names: list[str]) -> str:
    """What ``items_sha256`` of the query holds."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
