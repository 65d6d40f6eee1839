"""Secret scan with structural confirmation (operator 1).

Patterns find assigned secrets, access key ids and hex runs. Beyond them, base64 and
hex candidates are decoded and reported only if they parse: a private key whose
nested lengths all fit, an OpenSSH key blob, or a signed token with a JSON header.

Null and empty texts have no spans; every row gives one row, repeated rows included.
Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import picked, prepare

#: The kinds in the order of reports; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE = KINDS[:3]

#: The base patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Between two lines of a key: a line break, bare or written as an escape, and blanks around it.
BREAK = r"[\x20\t]*+(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*+"
BREAKS = re.compile(BREAK)
#: Runs that may hide a key: possessive, so a long run is read once. The letter of an escape is not part of one.
RUN64 = re.compile(
    r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt])|(?<=\\[nrt]))[A-Za-z0-9+/_-]{24,}+(?:" + BREAK + r"[A-Za-z0-9+/]{2,}+(?![_-]))*+={0,2}")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{16,}+)")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
SSH_MAGIC = b"openssh-key-v1\0"
#: Fixed value: where the identifiers of password-based encryption begin.
PKCS5 = b"\x2a\x86\x48\x86\xf7\x0d\x01\x05"

#: Values in one SEQUENCE of a key, and keys in one OpenSSH file, at most.
MOST_ITEMS, MOST_KEYS = 16, 16

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Coded:
    """The bytes that base64 characters stand for from a place on, decoded only where they are read."""

    def __init__(self, chars: str, at: int, size: int) -> None:
        self.chars, self.at, self.size = chars, at, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key):
        a, b, _ = key.indices(self.size) if isinstance(key, slice) else (key, key + 1, 1)
        quanta = _decode64(self.chars[self.at + a // 3 * 4 : self.at - (-b // 3) * 4])[a % 3 :][: max(b - a, 0)]
        return quanta if isinstance(key, slice) else quanta[0]


def _items(b: bytes | Coded, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``b[at:end]`` exactly, else None; a key has few."""
    out = []
    while at < end:
        if at + 2 > end or len(out) == MOST_ITEMS:
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der_key(b: bytes | Coded) -> bool:
    """A private key: one SEQUENCE whose nested lengths fit and whose fields are a key's."""
    outer = _items(b, 0, len(b)) if b[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _items(b, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags, (_, s, e) = [t for t, _, _ in inner], inner[0]
    if tags[0] == INTEGER and e - s == 1:
        if len(tags) in (6, 9) and set(tags) == {INTEGER}:
            return b[s] == 0 and all(y > x for _, x, y in inner)
        if tags[1] == OCTETS and b[s] == 1:
            return inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
        if tags[1:3] == [SEQUENCE, OCTETS] and b[s] in (0, 1):
            name = _items(b, *inner[1][1:])
            return bool(name) and name[0][0] == OID and inner[2][2] - inner[2][1] >= 16
        return False
    if tags == [SEQUENCE, OCTETS]:
        name = _items(b, s, e)
        return bool(name) and len(name) == 2 and name[0][0] == OID and b[name[0][1] : min(name[0][2], name[0][1] + len(PKCS5))] == PKCS5
    return False


def is_ssh_key(b: bytes | Coded) -> bool:
    """An OpenSSH key file: magic, then cipher, kdf, options, a count and length-prefixed keys."""
    return ssh_length(b) == len(b)


def _decode64(run: str) -> bytes:
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return b""


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """A JSON header naming an algorithm, a JSON body, and a signature of 16 bytes or more."""
    try:
        header, claims = json.loads(_decode64(head)), json.loads(_decode64(body))
    except (ValueError, RecursionError):
        return False
    named = isinstance(header, dict) and isinstance(header.get("alg"), str) and header["alg"].lower() != "none"
    return named and isinstance(claims, dict) and len(_decode64(signature)) >= 12


def key_kind(b: bytes | Coded) -> str | None:
    return "der" if is_der_key(b) else "ssh" if is_ssh_key(b) else None


def der_length(b: bytes) -> int:
    """The bytes of the value that ``b`` begins, if it may be a key's SEQUENCE, else 0."""
    k = b[1] & 0x7F if len(b) > 2 and b[1] >= 0x80 else 0
    if b[:1] != b"\x30" or k > 4 or len(b) < 3 + k or b[2 + k] not in (INTEGER, SEQUENCE):
        return 0
    return 2 + k + (int.from_bytes(b[2 : 2 + k], "big") if b[1] >= 0x80 else b[1])


def ssh_length(b: bytes | Coded) -> int:
    """The bytes of the OpenSSH key that ``b`` begins: its count says how many keys follow; else 0."""
    if b[: len(SSH_MAGIC)] != SSH_MAGIC:
        return 0
    at, fields, last = len(SSH_MAGIC), 0, 5
    while fields < last:
        if at + 4 > len(b):
            return 0
        n = int.from_bytes(b[at : at + 4], "big")
        if fields == 3:
            if not 1 <= n <= MOST_KEYS:
                return 0
            last, n = n + 5, 0
        at, fields = at + 4 + n, fields + 1
    return at if at <= len(b) else 0


def keys64(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in lines of base64 that begin and end with a line.

    A key says how long it is, so whatever lines stand before and after it do not matter.
    Of a candidate only a bounded number of lengths is decoded, however long it claims to be.
    """
    gaps = [m.span() for m in BREAKS.finditer(run)]
    stop = len(run.rstrip("="))
    lines = list(zip([0, *(e for _, e in gaps)], [*(s for s, _ in gaps), stop]))
    bare = "".join(run[s:e] for s, e in lines)
    ends, n = {}, 0  # where a line ends among the bare characters, and in the run
    starts = []
    for s, e in lines:
        starts.append(n)
        n += e - s
        ends[n] = e
    out, free = [], 0
    for at, (s, _) in zip(starts, lines):
        if at < free:
            continue
        if bare.startswith("M", at):
            size = der_length(_decode64(bare[at : at + 12]))
        elif bare.startswith("b3BlbnNzaC1rZXktdjEA", at):
            size = ssh_length(Coded(bare, at, (len(bare) - at) * 3 // 4))
        else:
            continue
        end = at + (4 * size + 2) // 3
        if size and end in ends and (kind := key_kind(Coded(bare, at, size))):
            out.append((kind, s, len(run) if ends[end] == stop else ends[end]))
            free = end
    return out


def signed_tokens(text: str) -> list[tuple[str, int, int]]:
    """Spans of signed tokens; after segments that are none, the search goes on with the second of them."""
    out, at = [], 0
    while m := TOKEN.search(text, at):
        signed = is_signed_token(*m.groups())
        if signed:
            out.append(("jwt", *m.span()))
        at = m.end() if signed else m.end(1) + 1
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in RUN16.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            found.append((kind, *m.span()))
    for m in RUN64.finditer(text):
        found += [(kind, m.start() + s, m.start() + e) for kind, s, e in keys64(m[0])]
    if "." in text:
        found += signed_tokens(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scanned(batches):
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] if t else [] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` (kind, start, end) of every row."""
    prepare(docs.sparkSession)
    bare = picked(docs, doc_id=id_col, text=text_col)
    return bare.mapInArrow(_scanned, f"doc_id {bare.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, mask: str) -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for _, s, e in scan(text):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with all columns and rows, secrets in the text replaced by ``mask``.

    A text without secrets stays as it is; null stays null.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called

    def masked(batches):
        for batch in batches:
            texts = [redacted(t, mask) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return plain.mapInArrow(masked, plain.schema).toDF(*docs.columns)


def recount(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the column of text lengths, if there is one, set anew."""
    if chars_col not in docs.columns:
        return docs
    return docs.withColumn(chars_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[chars_col].dataType))
