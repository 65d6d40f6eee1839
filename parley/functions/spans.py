"""Searching a text that lies in parts, as if it were whole.

A text's lines are grouped into parts, and a match may lie over any number of them. A pattern
is read as a chain of pieces that never match a line break, and of characters that may (``\\s``,
``[^.]``, ``.`` under ``(?s)``), single or repeated. A cut between two parts lies before a line
break, so a match that crosses it is at one of those characters: an *open state*. Each part sums
up, per state it may be entered in, which states it can be left in and whether the match ends
inside. These summaries are a few bits; they combine in part order, and no text is joined.

Patterns of another form (look-around, back references, line anchors of ``(?m)``, repeated groups
that hold line breaks) are searched in each piece of the text, an event, at every size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache, reduce
from itertools import product
from re import _constants as op, _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: As the rest of the package: any case, letters and words of Unicode.
FLAGS = "(?iU)"
#: Alternatives and open states of one pattern, and copies of a counted character, at most.
MOST_CHAINS, MOST_STATES, MOST_COPIES = 16, 8, 8

ONE, MAYBE, ANY, SOME = "", "?", "*", "+"


class Break(NamedTuple):
    """A character that may be a line break, and how often it comes."""

    source: str
    times: str

    @property
    def whole(self) -> str:
        return self.source + self.times

    @property
    def begun(self) -> str:
        """What of it lies before a cut."""
        return self.source + ANY if self.times in (ANY, SOME) else ""

    @property
    def left(self) -> str:
        """What of it lies after a cut, the line break first."""
        return self.source + SOME if self.times in (ANY, SOME) else self.source


class Chain(NamedTuple):
    """Pieces (text) and breaks in order; whether the pattern holds to the start or the end of the text."""

    items: tuple[str | Break, ...]
    starts: bool
    ends: str

    @property
    def cuts(self) -> list[int]:
        return [i for i, x in enumerate(self.items) if isinstance(x, Break)]


#: Anchors at the end of a text: before a last line break too, or not.
END = {op.AT_END: r"(?=\n?\z)", op.AT_END_STRING: r"\z"}


class _Outside(Exception):
    """The pattern is no chain."""


CATEGORY = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_NOT_DIGIT: r"\D", op.CATEGORY_SPACE: r"\s", op.CATEGORY_NOT_SPACE: r"\S",
            op.CATEGORY_WORD: r"\w", op.CATEGORY_NOT_WORD: r"\W"}
#: Categories that hold the line break.
BREAKING = {op.CATEGORY_NOT_DIGIT, op.CATEGORY_SPACE, op.CATEGORY_NOT_WORD}
LINE = ord("\n")


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:X}}}"


class _Reader:
    """A parsed pattern as pieces and breaks."""

    def __init__(self, flags: int) -> None:
        self.dotall, self.multiline = bool(flags & re.S), bool(flags & re.M)

    def single(self, node) -> tuple[str, bool] | None:
        """Source of a one-character node, and whether it may be a line break."""
        kind, value = node
        if kind is op.LITERAL:
            return _char(value), value == LINE
        if kind is op.NOT_LITERAL:
            return f"[^{_char(value)}]", value != LINE
        if kind is op.ANY:
            return (r"[\s\S]", True) if self.dotall else (r"[^\n]", False)
        if kind is op.IN:
            return self.charset(value)
        return None

    def charset(self, items) -> tuple[str, bool]:
        out, holds, negated = "", False, False
        for kind, value in items:
            if kind is op.NEGATE:
                negated = True
            elif kind is op.LITERAL:
                out, holds = out + _char(value), holds or value == LINE
            elif kind is op.RANGE:
                out, holds = out + f"{_char(value[0])}-{_char(value[1])}", holds or value[0] <= LINE <= value[1]
            elif kind is op.CATEGORY and value in CATEGORY:
                out, holds = out + CATEGORY[value], holds or value in BREAKING
            else:
                raise _Outside
        return f"[{'^' if negated else ''}{out}]", holds != negated

    def chains(self, nodes) -> list[list]:
        """The alternatives of a sequence, each a list of pieces and breaks."""
        parts = [self.node(n) for n in nodes]
        if reduce(lambda n, p: n * len(p), parts, 1) > MOST_CHAINS:
            raise _Outside
        return [[x for p in choice for x in p] for choice in product(*parts)]

    def node(self, node) -> list[list]:
        kind, value = node
        one = self.single(node)
        if one:
            return [[Break(one[0], ONE)]] if one[1] else [[one[0]]]
        if kind is op.AT:
            return self.anchor(value)
        if kind is op.SUBPATTERN:
            _, on, off, inner = value
            if on or off:
                raise _Outside
            return self.grouped(self.chains(inner))
        if kind is op.BRANCH:
            return self.grouped([c for branch in value[1] for c in self.chains(branch)])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            return self.repeated(*value, "?" if kind is op.MIN_REPEAT else "")
        raise _Outside

    def anchor(self, value) -> list[list]:
        if value in (op.AT_BOUNDARY, op.AT_NON_BOUNDARY):
            return [[r"\b" if value is op.AT_BOUNDARY else r"\B"]]
        if self.multiline and value in (op.AT_BEGINNING, op.AT_END):
            raise _Outside
        if value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END, op.AT_END_STRING):
            return [[value]]
        raise _Outside

    @staticmethod
    def grouped(chains: list[list]) -> list[list]:
        """Alternatives of nothing but pieces as one piece."""
        if all(isinstance(x, str) for c in chains for x in c):
            return [["(?:" + "|".join("".join(c) for c in chains) + ")"]]
        return chains

    def repeated(self, least: int, most: int, inner, lazy: str) -> list[list]:
        endless = most is op.MAXREPEAT
        one = self.single(inner[0]) if len(inner) == 1 else None
        if one and one[1]:
            if max(least, 0 if endless else most) > MOST_COPIES:
                raise _Outside
            copies = [Break(one[0], ONE)] * (least - (1 if endless and least else 0))
            rest = [Break(one[0], SOME if least else ANY)] if endless else [Break(one[0], MAYBE)] * (most - least)
            return [copies + rest]
        chains = self.grouped(self.chains(inner))
        if len(chains) == 1 and all(isinstance(x, str) for x in chains[0]):
            times = f"{{{least},{'' if endless else most}}}"
            return [[f"(?:{''.join(chains[0])}){times}{lazy}"]]
        if (least, most) == (0, 1):
            return [*chains, []]
        if (least, most) == (1, 1):
            return chains
        raise _Outside


def _chain(items: list) -> Chain:
    starts = (op.AT_BEGINNING, op.AT_BEGINNING_STRING)
    first, end = bool(items) and items[0] in starts, END.get(items[-1], "") if items else ""
    joined: list[str | Break] = []
    for x in items[first:len(items) - bool(end)]:
        if x in starts or x in END:
            raise _Outside
        if isinstance(x, str) and joined and isinstance(joined[-1], str):
            joined[-1] += x
        else:
            joined.append(x)
    made = Chain(tuple(joined), first, end)
    if len(made.cuts) > MOST_STATES:
        raise _Outside
    return made


@cache
def chains_of(pattern: str) -> tuple[Chain, ...] | None:
    """The pattern as alternatives, or None for one of another form."""
    try:
        tree = _parser.parse(pattern)
        return tuple(map(_chain, _Reader(tree.state.flags).chains(tree)))
    except (_Outside, re.error, OverflowError):
        return None


@cache
def literal_chain(text: str) -> Chain:
    """A plain text; each of its line breaks is an open state."""
    lines = [piece for line in text.split("\n") for piece in (re.escape(line), Break(r"\n", ONE))][:-1]
    return Chain(tuple(x for x in lines if x != ""), False, "")


# ---- over parts -----------------------------------------------------------------------

def _source(items: Sequence[str | Break]) -> str:
    return "".join(x.whole if isinstance(x, Break) else x for x in items)


def _summary(chain: Chain, text: Column, first: Column, last: Column, flags: str) -> Column:
    """Per state a part may be entered in, the states it can be left in, as bits.

    State 0 is a match not begun, state j a match cut at the j-th break, and the highest one a match that has ended.
    """
    items, cuts = chain.items, chain.cuts
    done = len(cuts) + 1
    nothing = F.lit(0).cast("long")

    def found(pattern: str, state: int, when: Column) -> Column:
        bit = F.lit(1 << state).cast("long")
        return F.when(when & F.coalesce(text.rlike(flags + pattern), F.lit(False)), bit).otherwise(nothing)

    rows = []
    for state in range(done):
        begin = cuts[state - 1] if state else -1
        head = (r"\A" if chain.starts else "") if state == 0 else r"\A" + items[begin].left
        enter = (first if chain.starts else F.lit(True)) if state == 0 else ~first
        out = [found(head + _source(items[begin + 1:]) + chain.ends, done, enter & (last if chain.ends else F.lit(True)))]
        for later in range(state + 1, done):
            end = cuts[later - 1]
            out.append(found(head + _source(items[begin + 1:end]) + items[end].begun + r"\z", later, enter & ~last))
        if state and items[begin].times in (ANY, SOME):
            out.append(found(head + r"\z", state, enter & ~last))
        rows.append(reduce(Column.bitwiseOR, out))
    return F.array(*rows)


def _ended(chain: Chain, summaries: Column) -> Column:
    """Whether a match ends anywhere, over the summaries of the parts in order."""
    done = len(chain.cuts) + 1
    begun, end = F.lit(1).cast("long"), F.lit(1 << done).cast("long")

    def through(states: Column, part: Column) -> Column:
        reached = [F.when(states.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.get(part, F.lit(i))).otherwise(F.lit(0).cast("long")) for i in range(done)]
        return reduce(Column.bitwiseOR, reached, begun.bitwiseOR(states.bitwiseAND(end)))

    return F.aggregate(summaries, begun, through).bitwiseAND(end) != 0


def _in_order(value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col("part").alias("part"), value.alias("value")))), lambda x: x["value"])


def _any(found: Column) -> Column:
    return F.coalesce(F.bool_or(found), F.lit(False))


def _over_parts(chain: Chain, text: Column, flags: str) -> Column:
    first, last = F.col("part") == 0, F.col("last")
    # a part after the first begins with the line break before it
    own = F.when(first, text).otherwise(F.concat(F.lit("\n"), text))
    if not chain.cuts:
        done = F.get(_summary(chain, own, first, last, flags), F.lit(0))
        return _any(done != 0)
    return _ended(chain, _in_order(_summary(chain, own, first, last, flags)))


def pattern_found(pattern: str | None, text: Column, pieces: Column) -> Column:
    """Aggregate over the parts of a text: whether the pattern occurs in it.

    The table has ``part`` (from 0) and ``last`` beside the columns given; ``pieces`` are what a
    pattern that is no chain is searched in one by one.
    """
    if not pattern:
        return F.lit(False)
    chains = chains_of(pattern)
    if chains is None:
        return _any(F.exists(pieces, lambda p: p.rlike(FLAGS + pattern)))
    return reduce(Column.__or__, [_over_parts(c, text, FLAGS) for c in chains])


def text_found(needle: str, text: Column) -> Column:
    """Aggregate over the parts of a text: whether it holds a plain text."""
    if "\n" not in needle:
        return _any(F.contains(text, F.lit(needle)))
    return _over_parts(literal_chain(needle), text, "")


def opening_of(text: Column, chars: int) -> Column:
    """Aggregate over the parts of a text: its first characters. Every part has a character and a break at least."""
    early = F.when(F.col("part") < chars, F.struct(F.col("part").alias("part"), F.substring(text, 1, chars).alias("head")))
    return F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(early)), lambda x: x["head"]), "\n"), 1, chars)


def parts_of(text: DataFrame, key: str = "session_id") -> DataFrame:
    """A table of texts with the columns the searches read: (key, part, last, searchable_text, pieces)."""
    out = text.withColumn("searchable_text", F.coalesce("searchable_text", F.lit("")))
    if "last" not in text.columns:
        out = out.withColumn("last", F.col("part") == F.max("part").over(W.partitionBy(key)))
    return out if "pieces" in text.columns else out.withColumn("pieces", F.array("searchable_text"))
