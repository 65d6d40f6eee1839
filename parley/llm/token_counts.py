"""Token counts that follow edits (operator 7).

A byte-level BPE never joins bytes of two pre-tokens, so a text's token count is a sum
over its pre-tokens. Blocks of pre-tokens are the leaves of a tree per document that
holds lengths and token counts. An edit re-encodes from the last block border that the
edit cannot move (a pre-token is settled two characters before it) up to the first old
border after the edit that is a border again, and updates the sums above those leaves.

Null and empty texts have no tokens. Repeated rows are counted each by itself. Edits of
a document are character ranges of the text before all edits, and must not overlap.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from parley.llm.common import picked, prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a leaf; characters to the right of a pre-token that may change it.
BLOCK, CONTEXT = 32, 2
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, ranks: bytes) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern, self.known = regex.compile(PATTERN), {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding._encode_single_piece(piece))
        return n


class TokenTree:
    """Texts, lengths and token counts of a text's blocks, with the sums in a binary tree.

    ``sums[k]`` is (characters, tokens) of node k; leaves start at ``width``. An edit costs
    what the blocks it touches hold and the logarithm of their number, wherever it is.
    """

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter, self.recounted = counter, 0
        pieces = counter.pattern.findall(text)
        at = np.arange(0, len(pieces), BLOCK)
        n = max(1, len(at))
        self.width = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.blocks = ["".join(pieces[i : i + BLOCK]) for i in at.tolist()] or [""]
        if pieces:
            each = np.array([list(map(len, pieces)), list(map(counter.count, pieces))], np.int64)
            self.sums[self.width : self.width + n] = np.add.reduceat(each, at, axis=1).T
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @property
    def text(self) -> str:
        return "".join(self.blocks)

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def _block(self, at: int) -> tuple[int, int]:
        """The last block that starts at or before a character, and its start."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.sums[node, 0] and self.sums[node + 1, 0] > 0:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def _next(self, block: int) -> int | None:
        """The first block after this one that holds text, past subtrees that hold none."""
        node = block + self.width
        while node > 1 and (node & 1 or not self.sums[node + 1, 0]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.width:
            node *= 2
            if not self.sums[node, 0]:
                node += 1
        return node - self.width

    def _put(self, block: int, text: str, tokens: int) -> None:
        node = block + self.width
        self.blocks[block] = text
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]``; the tree then is that of the new text."""
        block, begin = self._block(max(0, start - CONTEXT))
        taken, size = [block], len(self.blocks[block])
        following = self._next(block)

        def take(chars: int) -> None:
            nonlocal size, following
            while following is not None and size < chars:
                taken.append(following)
                size += len(self.blocks[following])
                following = self._next(following)

        take(end - begin + 1)
        wanted = size + 1
        while True:
            take(wanted)
            old = "".join([self.blocks[k] for k in taken])
            text = old[: start - begin] + new + old[end - begin :]
            done = self._retake(taken, text, len(text) - len(old), end - begin, start - begin + len(new), following is None)
            if done:
                break
            wanted = 2 * size  # what follows may still change the last pre-tokens
        kept, tokens, last, recounted = done
        self.recounted += recounted
        for k in taken[1 : last + 1]:
            self._put(k, "", 0)
        self._put(block, text[:kept], tokens)

    def _retake(self, taken: list[int], text: str, shift: int, old_end: int, new_end: int, whole: bool) -> tuple[int, int, int, int] | None:
        """Count from the start up to an old border beyond the edit: (characters, tokens, place in ``taken`` of the last
        block counted in, pre-tokens), or None where the text given ends too soon to tell."""
        borders, at = {}, 0
        for place, k in enumerate(taken):
            at += len(self.blocks[k])
            if at >= old_end and at + shift >= new_end:
                borders[at + shift] = place
        tokens = n = 0
        for m in self.counter.pattern.finditer(text):
            if m.start() in borders and m.start() >= new_end and n:
                return m.start(), tokens, borders[m.start()], n
            if not whole and m.end() > len(text) - CONTEXT:
                return None
            tokens += self.counter.count(m[0])
            n += 1
        return (len(text), tokens, len(taken) - 1, n) if whole else None


def repeated_lines(text: str) -> list[tuple[int, int, str]]:
    """Edits that take out lines with a word which equal an earlier line."""
    seen, edits, at = set(), [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                edits.append((at, end, ""))
            seen.add(line)
        at += len(line) + 1
    return edits


NUMBER = regex.compile(r"\d{6,}")


def long_numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask runs of six digits or more."""
    return [(*m.span(), "<number>") for m in NUMBER.finditer(text)]


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Both kinds of edits, by place; a number in a line that goes has no edit of its own."""
    lines = repeated_lines(text)
    gone = np.array([e[:2] for e in lines], np.int64).reshape(-1, 2)
    kept = []
    for edit in long_numbers(text):
        k = int(np.searchsorted(gone[:, 0], edit[0], "right")) - 1
        if k < 0 or edit[0] >= gone[k, 1]:
            kept.append(edit)
    return sorted(lines + kept)


def count_tokens(docs: DataFrame, edits=cleaning_edits, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, n_edits, n_recounted (pre-tokens), n_tokens_after.

    ``edits`` gives a text's edits (start, end, new text). The vocabulary file is read
    once, by the driver, and sent to the workers; it has a fixed size.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    bare = picked(docs, doc_id=id_col, text=text_col)

    def counted(batches):
        counter = Counter(ranks.value)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                tree = TokenTree(counter, text or "")
                before = tree.n_tokens
                todo = edits(text or "")
                for edit in reversed(todo):  # from the right, so the offsets to the left hold
                    tree.edit(*edit)
                rows.append((before, len(todo), tree.recounted, tree.n_tokens))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_tokens", "n_edits", "n_recounted", "n_tokens_after"])

    kind = bare.schema["doc_id"].dataType.simpleString()
    return bare.mapInArrow(counted, f"doc_id {kind}, n_tokens bigint, n_edits bigint, n_recounted bigint, n_tokens_after bigint")
