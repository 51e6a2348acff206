"""Token ids of whole texts from a vocabulary file of the tokenizers library, a batch at a time.

A text is cut before every space that follows a character other than white
space.  No pre-token of the two supported kinds of file (byte-level BPE, and
lower-case BPE with word ends that drops white space) crosses such a place,
so the ids of the parts, in order, are the ids of the text.  The parts are
words, most of which come again and again: their ids are kept in a bounded
dictionary, and the library encodes only the parts that are not in it.  In a
part of Latin letters, marks and single line ends, each run is a pre-token,
which goes straight to the library's model; all other parts go through the
whole of the library.

Many texts at once are cut by Arrow (``Bulk``).  Where white space stands alone and
full stops and commas follow a letter or digit, which holds for nearly every text, a
pre-token ends at line ends and before these marks too, and the text is also cut
there.  Each distinct part is looked up once, and those that are new go to
the library's model together.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The library's own threads would take cores that Spark gives to other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but for the apostrophe, which can begin an English ending
_PLAIN = re.compile(rf"[{_LETTERS}{_MARKS}](?:[{_LETTERS}{_MARKS}]|\n(?=[{_LETTERS}{_MARKS}]))*")
_RUNS = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+|\n")

# Texts that are cut before spaces only: neighbouring white space, a stop or comma after anything but a
# digit or a letter that stays one letter when lower-cased and normalised, and the mark of parts without a space.
_WHITE = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
_ODD = rf"[{_WHITE}][{_WHITE}]|[^0-9{_LETTERS}А-я][.,]|\x00"
_JOINED = "\0"  # begins a part that does not follow a space
_WORD = rf"^\x00?[{_LETTERS}]+$"

MANY = 100_000  # characters from which texts are encoded by ``Bulk``
GATHERED = 3_000_000  # characters of texts that are encoded at once
WORDS = 1 << 15  # new words that go to the library at once
LONG = 1 << 26  # characters of a text that Arrow is not given, as its offsets have 32 bits
SHORT = 8  # characters of a part or pre-token that is kept longest
ID_BYTES = 4  # ids are kept as little-endian unsigned 32-bit integers


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary file lies (the same package is on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_faces() -> str:
    """The 256 bytes as the byte-level alphabet writes them.

    That alphabet shows printable bytes as the character of the same number
    and the others, in order, as the characters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class _Kept(dict):
    """What was found for a key, up to a number of keys; beyond it the short ones stay, which come most often."""

    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            short = {k: v for k, v in self.items() if len(k) <= SHORT}
            self.clear()
            if len(short) < self.most * 3 // 4:
                self.update(short)
        found = self[key] = self.find(key)
        return found


class Encoder:
    """Whole texts to ids; ``kept`` bounds the dictionaries of parts and pre-tokens."""

    def __init__(self, path: str, kept: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.model = self.library.model
        self.lower = self.library.normalizer is not None
        self.before = "" if self.lower else "Ġ"
        self.faces = _byte_faces()
        self.tokens = _Kept(self._token, kept)
        self.parts = _Kept(self._part, kept)
        self.bulk = Bulk(self)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, run: str, before: str = "") -> bytes:
        """The ids of a run of letters or marks, a pre-token."""
        shown = run if run.isascii() else charmap_decode(run.encode(), "strict", self.faces)[0]
        return array("I", [t.id for t in self.model.tokenize(before + shown)]).tobytes()

    def _token(self, pre_token: str) -> bytes:
        """The ids of a run within a part, or of a line end."""
        if pre_token == "\n":
            return b"" if self.lower else self._whole(["\n"])[0]
        return self._run(pre_token)

    def _part(self, part: str) -> bytes:
        """The ids of a part that follows a space."""
        if part.isalpha() and part.isascii():
            return self._run(part.lower() if self.lower else part, self.before)
        if _PLAIN.fullmatch(part) is None:
            return self._whole([" " + part])[0]
        runs = _RUNS.findall(part.lower() if self.lower else part)
        if len(runs) == 1:
            return self._run(runs[0], self.before)
        get = self.tokens.__getitem__
        return self.parts[runs[0]] + b"".join([get(r) for r in runs[1:]])  # the first run is a part too

    def joined(self, part: str) -> bytes:
        """The ids of a part that does not follow a space."""
        if _PLAIN.fullmatch(part) is None:
            return self._whole([part])[0]
        return b"".join([self.tokens[r] for r in _RUNS.findall(part.lower() if self.lower else part)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if sum(map(len, texts)) < MANY:
            return self._each(texts)
        regular = self.bulk.regular(texts)
        many, each = iter(self.bulk.encode([t for t, r in zip(texts, regular) if r])), iter(self._each([t for t, r in zip(texts, regular) if not r]))
        return [next(many if r else each) for r in regular]

    def _each(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if _SPACE_AFTER_SPACE.search(t) else t.split(" ") for t in texts]
        get = self.parts.__getitem__
        return [first + b"".join(map(get, parts[1:])) for first, parts in zip(self._whole([p[0] for p in cut]), cut)]


class Bulk:
    """Many texts at once to ids: ``parts`` (each distinct part, as cut) and ``ids`` (its ids) hold up to ``kept`` of them."""

    def __init__(self, encoder: Encoder, kept: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder, self.kept = encoder, kept
        self.parts, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.end = encoder.faces[ord("\n")]
        self.words = Tokenizer(encoder.model)  # words in the byte-level alphabet, one a line
        self.words.pre_tokenizer = pre_tokenizers.Split(self.end, "isolated")
        self.line_end = encoder.model.tokenize(self.end)[0].id

    def regular(self, texts: list[str]) -> list[bool]:
        """Whether a text can be cut at line ends and before stops and commas too."""
        short = pa.array([t if len(t) <= LONG else None for t in texts], pa.string())
        return pc.invert(pc.match_substring_regex(short, _ODD)).fill_null(False).to_pylist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each regular text."""
        marked = pc.binary_join_element_wise(_JOINED, pa.array(texts, pa.string()), "")
        for mark, parted in (("\n", f" {_JOINED}\n {_JOINED}"), (".", f" {_JOINED}."), (",", f" {_JOINED},")):
            marked = pc.replace_substring(marked, mark, parted)
        cut = pc.split_pattern(marked, " ")
        found = cut.flatten().dictionary_encode()
        ids = self._ids(found.dictionary).take(found.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int32)[cut.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        view = memoryview(data or b"")
        return [bytes(view[a:b]) for a, b in zip(ends, ends[1:])]

    def _ids(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts; they are kept, and when that is too much only the short ones stay."""
        at = pc.index_in(parts, self.parts).fill_null(-1).to_numpy().copy()
        fresh = at < 0
        new = parts.filter(pa.array(fresh))
        word = pc.match_substring_regex(new, _WORD)
        words, others = new.filter(word), new.filter(pc.invert(word))
        made = pa.array([self.encoder.joined(p[1:]) if p.startswith(_JOINED) else self.encoder._part(p) for p in others.to_pylist()], pa.binary())
        held, held_ids = pa.concat_arrays([self.parts, words, others]), pa.concat_arrays([self.ids, *[self._words(words.slice(i, WORDS)) for i in range(0, len(words), WORDS)], made])
        is_word = word.to_numpy(zero_copy_only=False)
        at[np.flatnonzero(fresh)[np.argsort(~is_word, kind="stable")]] = np.arange(len(self.parts), len(held))
        ids = held_ids.take(pa.array(at))
        if len(held) > self.kept:
            short = pc.less_equal(pc.utf8_length(held), SHORT)
            short = short if pc.sum(short).as_py() < self.kept * 3 // 4 else pa.array(np.zeros(len(held), bool))
            held, held_ids = held.filter(short), held_ids.filter(short)
        self.parts, self.ids = held, held_ids
        return ids

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of parts that are one run of letters, a pre-token."""
        spaced = " " if self.encoder.before else ""
        lines = "\n".join([w[1:] if w[0] == _JOINED else spaced + w for w in words.to_pylist()])
        shown = charmap_decode((lines.lower() if self.encoder.lower else lines).encode(), "strict", self.encoder.faces)[0]
        ids = np.array(self.words.encode_batch_fast([shown + self.end], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.line_end)
        own = np.delete(ids, ends)
        borders = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32) * ID_BYTES
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(borders), pa.py_buffer(own)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker: that of the file used last."""
    return Encoder(path)


def release() -> None:
    """Give back the encoder that an earlier stage left in this Python worker."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def batches(texts: list[str], most_chars: int = 1_000_000):
    """Slices of ``texts`` of about ``most_chars`` characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most_chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encoded_batches(it: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to batches of (doc_id, ids): the ids of each whole text and the end id."""
    end = struct.pack("<I", end_id)
    for batch in it:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for s in batches(texts, GATHERED):
            out = [b + end for b in encoder(path).encode(texts[s])]
            yield pa.record_batch([ids.slice(s.start, s.stop - s.start), pa.array(out, pa.binary())], ["doc_id", "ids"])
