"""Chat formatting with a grammar round trip (operator 4).

A conversation is written as a row of turns

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

and read back by a deterministic parser. A turn that does not come back as it was has
its conflicting strings escaped, and is tried again until it does: a control string
gets a backslash after its ``<``; strings that already look like that get one more, so
that taking one away undoes it. Roles escape line breaks and backslashes likewise.

Turns are rendered where they lie; one shuffle then sorts them by conversation, and a
conversation of any length streams through its task a turn at a time. Null text and
role are empty, a null turn comes first, a null conv_id is one conversation, equal
turns are ordered by role and text, and repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.common import picked, prepare

#: The control strings and the role whose texts are trained on.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"

CONTROL = re.compile(r"<(\\*)\|im_(start|end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|im_\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|im_\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text as written.

    Raises ValueError where the string does not follow the grammar.
    """
    turns, at = [], 0
    while at < len(formatted):
        head = at + len(START)
        line = formatted.find("\n", head)
        end = formatted.find(END, line)
        role, text = formatted[head:line], formatted[line + 1 : end]
        if not formatted.startswith(START, at) or line < 0 or end < 0 or formatted[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        if START in role or END in role or START in text:
            raise ValueError(f"a control string inside the turn at {at}")
        turns.append((unescape_role(role), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return turns


def comes_back(piece: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(piece)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """The turn as written; only what would not come back is escaped."""
    head, body = role, text
    for step in (lambda: (role, text), lambda: (role, escape(text)), lambda: (escape_role(role), escape(text))):
        head, body = step()
        piece = f"{START}{head}\n{body}{END}\n"
        if comes_back(piece, role, text):
            return piece
    raise ValueError("the grammar cannot hold this turn")


def _rendered(batches):
    for b in batches:
        roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
        pieces = [render(r or "", t or "") for r, t in zip(roles, texts)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.string())], [*b.schema.names, "piece"])


def _placed(batches):
    """Offsets in the conversation; expects turns sorted by conversation."""
    last, at, seq = object(), 0, 0
    for b in batches:
        start, first, end, seqs = [], [], [], []
        for conv, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist()):
            if conv != last:
                last, at, seq = conv, 0, 0
            (role, _, s, e), = parse(piece)
            start.append(at)
            seqs.append(seq)
            first.append(at + s if role == TRAINED else None)
            end.append(at + e if role == TRAINED else None)
            at, seq = at + len(piece), seq + 1
        longs = [pa.array(x, pa.int64()) for x in (seqs, start, first, end)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), longs[0], b.column("piece"), *longs[1:]],
                                         ["conv_id", "seq", "piece", "start", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation as its pieces in order: conv_id, seq, piece, start, loss_start, loss_end.

    The pieces joined are the formatted conversation. ``start`` is the piece's place in
    it; loss_start and loss_end bound the text that is trained on, null for other turns.
    All pieces of a conversation lie in one partition, in order.
    """
    prepare(turns.sparkSession)
    bare = picked(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in bare.schema.fields]
    pieces = bare.mapInArrow(_rendered, ", ".join([*kinds, "piece string"]))
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "piece")
    return ordered.mapInArrow(_placed, f"{kinds[0]}, seq bigint, piece string, start bigint, loss_start bigint, loss_end bigint")


def _digested(batches):
    """Digests of what a reader of the formatted conversations gets back."""
    def row():
        return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), total]

    conv, n, chars, total, turns, loss, kind = None, 0, 0, 0, None, None, pa.int64()
    for b in batches:
        kind, rows = b.schema.field("conv_id").type, []
        for r in b.to_pylist():
            if r["seq"] == 0:
                if turns is not None:
                    rows.append(row())
                conv, n, chars, total, turns, loss = r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            piece = r["piece"]
            for role, text, _, _ in parse(piece):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if r["loss_start"] is not None:
                masked = unescape(piece[r["loss_start"] - r["start"] : r["loss_end"] - r["start"]])
                loss.update(masked.encode())
                chars += len(masked)
            total += len(piece)
        if rows:
            yield _table(rows, kind)
    if turns is not None:
        yield _table([row()], kind)


def _table(rows, kind):
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the pieces: turns, masked text, length.

    Takes the frame of ``format_conversations`` as it is: its order must not be changed.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_digested, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
