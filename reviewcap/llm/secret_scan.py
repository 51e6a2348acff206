"""Secret scan with a recursive decoding worklist.

Three patterns are looked for in a text and in every layer that decoding
brings out of it, at any depth.  A layer is

* escapes: the lines of a layer that hold ``%41`` (runs of these are UTF-8),
  ``\\u0041``, ``\\x41``, ``\\U00000041``, ``&#65;`` or ``&#x41;``, with each
  replaced by its character.  No pattern crosses a line end, so lines see
  what the whole would;
* base64: a run of base64 or base64url characters (over several lines too)
  that begins with bytes of UTF-8 text or of a compressed stream, read from
  each of its first four places and after each ``+ / - _``, as other
  characters can stand before it;
* compressed: such bytes, or those of a run of ``%41``, that are a zlib,
  gzip, bzip2 or xz stream.

Every character of a layer carries the span of the original text that it came
from, so that a find is a span of code points of the original.  The worklist
ends when no layer brings out another; a layer equal to one met before at the
same place (a stream that holds itself) is not followed again.  A stream that
would grow beyond ``MOST_GROWTH`` characters a document is not followed, and
its whole span is reported as ``opaque``, so that nothing passes unread.

Work is linear in a text and its layers; they lie in memory one document at a
time.  Defined results: a null text counts as empty; rows that repeat an id
are scanned each; a null id is an id; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

# The kinds of finds, in the order that breaks ties, with the least length of each.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of a run of these characters the first place has the longest rest
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

MOST_GROWTH = 1 << 26  # characters that decompression may bring out of one document
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
LEAST_RUN, LEAST_READ = 16, 10  # characters of a base64 run, and of the text that it holds
BETWEEN = re.compile(r"[+/]")
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}(?:\r?\n[A-Za-z0-9+/_-]{{{LEAST_RUN},}})*(?:\r?\n[A-Za-z0-9+/_-]+)?={{0,2}}")
TEXT_BYTES = bytes(c for c in range(256) if c >= 32 and c != 127 or c in b"\t\n\r\x0b\f")
STANDARD = str.maketrans("-_", "+/", "\r\n")

Span = tuple[str, int, int]


@dataclass
class Layer:
    """A text; ``start`` and ``end`` are, for each character, the span of the original it came from (None: the text is the original)."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def place(self, a: int, b: int) -> tuple[int, int]:
        """The original span of the characters a to b."""
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def part(self, text: str, first: np.ndarray, after: np.ndarray) -> Layer:
        """A layer whose characters come from the spans first to after (none empty) of this one."""
        return Layer(text, first, after) if self.start is None else Layer(text, self.start[first], self.end[after - 1])

    def key(self) -> bytes:
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        if self.start is not None:
            digest.update(self.start.tobytes() + self.end.tobytes())
        return digest.digest()


def finds(text: str) -> Iterator[Span]:
    """The patterns' own finds in one text."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= LEAST_ASSIGNED:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class TooLarge(Exception):
    """A stream grows beyond what may be held."""


def decompressed(raw: bytes, most: int) -> bytes | None:
    """What a compressed stream holds (what follows it is left out), or None."""
    if raw[:2] == b"\x1f\x8b":
        tool = zlib.decompressobj(31)
    elif len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        tool = zlib.decompressobj()
    elif raw[:3] == b"BZh":
        tool = bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\x00":
        tool = lzma.LZMADecompressor(memlimit=1 << 28)
    else:
        return None
    try:
        out = tool.decompress(raw, most + 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return None
    if len(out) > most:
        raise TooLarge
    return out or None


def readable(raw: bytes) -> str:
    """The text that the bytes begin with."""
    other = raw.translate(None, TEXT_BYTES)
    own = raw[:raw.index(other[:1])] if other else raw
    try:
        return own.decode("utf-8")
    except UnicodeDecodeError as e:
        return own[:e.start].decode("utf-8")


def either(raw: bytes) -> str:
    """The bytes as UTF-8, or where they are none, a character a byte."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _char_bytes(text: str) -> np.ndarray:
    """The first byte of each character of a UTF-8 text, and its length."""
    sizes = np.fromiter((1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text), np.int64, len(text))
    return np.concatenate([[0], np.cumsum(sizes)])


def _unescaped(m: re.Match) -> list[tuple[str, int, int]]:
    """The characters of an escape with their spans."""
    own, at = m.group(), m.start()
    if own[0] == "%":
        raw = bytes.fromhex(own.replace("%", ""))
        text = either(raw)
        edge = _char_bytes(text) if len(text) < len(raw) else range(len(raw) + 1)
        return [(c, at + 3 * int(edge[i]), at + 3 * int(edge[i + 1])) for i, c in enumerate(text)]
    decimal = own[0] == "&" and own[2] not in "xX"
    code = int(own[2:-1]) if decimal else int(own.rstrip(";").lstrip("&#\\")[1:], 16)
    return [(chr(code), at, m.end())] if code < 0x110000 else [(c, at + i, at + i + 1) for i, c in enumerate(own)]


def escape_layers(layer: Layer) -> Iterator[tuple[str, Layer | bytes, int, int]]:
    """Lines with their escapes replaced, and the bytes of percent runs."""
    text, done = layer.text, 0
    if not any(c in text for c in "%\\&"):
        return
    for m in ESCAPE.finditer(text):
        if m.group()[0] == "%":
            yield "bytes", bytes.fromhex(m.group().replace("%", "")), m.start(), m.end()
        if m.start() < done:
            continue
        lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        done = hi = len(text) if hi < 0 else hi
        chars, first, after, at = [], [], [], lo
        for e in ESCAPE.finditer(text, lo, hi):
            found = _unescaped(e)
            chars.append(text[at:e.start()])
            first.append(np.arange(at, e.start()))
            after.append(np.arange(at + 1, e.start() + 1))
            chars.append("".join(c for c, _, _ in found))
            first.append(np.array([a for _, a, _ in found], np.int64))
            after.append(np.array([b for _, _, b in found], np.int64))
            at = e.end()
        chars.append(text[at:hi])
        first.append(np.arange(at, hi))
        after.append(np.arange(at + 1, hi + 1))
        own = "".join(chars)
        if own != text[lo:hi]:
            yield "layer", layer.part(own, np.concatenate(first), np.concatenate(after)), lo, hi


def _decoded(run: str) -> bytes:
    """The bytes of whole groups and of a rest of two or three characters."""
    own = run.rstrip("=")
    own = own[:len(own) - 1] if len(own) % 4 == 1 else own
    return base64.b64decode(own + "=" * (-len(own) % 4))


def base64_layers(layer: Layer) -> Iterator[tuple[str, Layer | bytes, int, int]]:
    """Texts that base64 runs hold, and compressed bytes."""
    for m in RUN.finditer(layer.text):
        own = m.group()
        joined = own.translate(STANDARD)
        wrapped = len(joined) < len(own)
        places = np.array([i for i, c in enumerate(own) if c not in "\r\n"], np.int64) + m.start() if wrapped else None
        read: set[int] = set()
        for skip in (*range(4), *(i.end() for i in BETWEEN.finditer(joined) if i.end() > 3)):
            # A place that no base64 begins at shows it in its first bytes, nearly always.
            head = _decoded(joined[skip:skip + 8])
            packed = head[:2] in (b"\x1f\x8b", b"BZ", b"\xfd7") or head[:1] == b"\x78"
            if skip % 4 in read or len(head) < 6 or not packed and head.translate(None, TEXT_BYTES):
                continue
            raw = _decoded(joined[skip:])
            if packed:
                yield "bytes", raw, m.start() + skip if places is None else int(places[skip]), m.end()
            text = readable(raw)
            if len(text) < LEAST_READ:
                continue
            read.add(skip % 4)  # a later place of this alignment would read an end of the same bytes
            edge = _char_bytes(text)
            first, after = skip + edge[:-1] * 8 // 6, skip + (edge[1:] * 8 - 1) // 6 + 1
            if places is None:
                yield "layer", layer.part(text, first + m.start(), after + m.start()), m.start(), m.end()
            else:
                yield "layer", layer.part(text, places[first], places[after - 1] + 1), m.start(), m.end()


def scan(text: str, most_growth: int = MOST_GROWTH) -> tuple[list[Span], list[Span]]:
    """The finds in the text itself, and those of all its layers, each in order."""
    base, all_finds, left = sorted_spans(finds(text)), set(), most_growth
    work, met = [Layer(text)], set()
    while work:
        layer = work.pop()
        if layer.start is not None:
            key = layer.key()
            if key in met:
                continue
            met.add(key)
            all_finds.update((kind, *layer.place(a, b)) for kind, a, b in finds(layer.text))
        for kind, found, a, b in (*escape_layers(layer), *base64_layers(layer)):
            if kind == "layer":
                if found.text:
                    work.append(found)
                continue
            try:
                raw = decompressed(found, left)
            except TooLarge:
                all_finds.add(("opaque", *layer.place(a, b)))
                continue
            if raw:
                own = either(raw)
                left -= len(raw)
                work.append(layer.part(own, np.full(len(own), a), np.full(len(own), b)))
    return base, sorted_spans(all_finds.union(base))


def sorted_spans(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans of every row: arrays of (kind, start, end) in code points, end exclusive.

    ``base`` are the patterns' finds in the text as it stands; ``spans`` has these and all that decoding brought out.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(found: list[list[Span]]) -> pa.Array:
            return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found],
                            pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

        for batch in it:
            found = [scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), arrays([b for b, _ in found]), arrays([s for _, s in found])], ["doc_id", "base", "spans"])

    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def count_of(spans: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
