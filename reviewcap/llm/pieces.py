"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is the one whose pieces have the largest sum
of weights.  A model file of the unigram kind gives each piece its score (of equal
sums, the longest last piece wins at every place).  In one of the BPE kind a
way is allowed (weight 0) if each two neighbouring pieces stay as they are
when encoded alone, which leaves one way, the library's own; see ``merges``.
Both give the ids of the library; files of other kinds are refused.  The score
of a text is the sum of its pieces' scores, in double precision.

A text is cut where no piece can lie across (before a run of space marks that
follows another character, as the vocabulary allows), and the parts, most of
which come again and again, are looked up or searched side by side.

A giant text is split every ``CHUNK`` characters, wherever that falls.  The
state at a border is what lies across it: how far a piece reaches (unigram), or
which piece it is (BPE).  A chunk is a matrix of the best weights
from each state at its start to each state at its end; matrices combine by
the max-plus product, which is associative, so a scan over a text's matrices
gives the weight of every state at every border.  From these each chunk finds,
on its own, the state it was entered by for each state it is left by; those
maps compose to the states that were taken, and each chunk traces back its own
ids.  The result is the same as that of one search over the whole text.

Defined results: a null text counts as empty, which has no ids; a character
without a piece becomes the pieces of its UTF-8 bytes; decoding gives the
text back but for the space mark (U+2581), which the model itself reads as a
space; rows that repeat an id are encoded each; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches
from .common import col, stored
from .merges import PARTS, SPACE, Merges

CHUNK = 8192  # characters of a giant text's chunk
LOWEST = -np.inf


def read_model(path: str):
    """The pieces, scores and settings of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


class Decoder:
    """The text that ids stand for."""

    def __init__(self, path: str):
        model = read_model(path)
        kinds = type(model.pieces[0])
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in model.pieces]

    def decode(self, ids: bytes) -> str:
        raw = b"".join([self.bytes[i] for i in np.frombuffer(ids, np.uint32).tolist()])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Vocabulary:
    """Pieces and scores of a unigram model, as tables for a search over many texts at once."""

    before = 0  # characters before a chunk that its search looks at
    after_text = False

    def __init__(self, model, kept: int = 200_000):
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.UNIGRAM:
            raise ValueError("the scores of this model file are not those of the unigram kind")
        kinds = type(model.pieces[0])
        self.prefix = spec.add_dummy_prefix
        normal = {p.piece: (i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.id = {p: i for p, (i, _) in normal.items()}
        self.unknown = min(s for _, s in normal.values()) - 10.0
        self.longest = max(map(len, normal))
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in normal)
        # A tree of the pieces: the child of node v by character c is found under v * 2**21 + c.
        keys: dict[int, int] = {}
        self.node_id, self.node_score = [-1], [LOWEST]
        for piece, (i, score) in normal.items():
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                if key not in keys:
                    keys[key] = len(self.node_id)
                    self.node_id.append(-1)
                    self.node_score.append(LOWEST)
                at = keys[key]
            self.node_id[at], self.node_score[at] = i, score
        self.children = pd.Index(np.fromiter(keys, np.int64, len(keys)))
        self.child_node = np.fromiter(keys.values(), np.int64, len(keys))
        self.node_id, self.node_score = np.array(self.node_id), np.array(self.node_score)
        self.kept = kept
        self.known: dict[str, tuple[bytes, float]] = {}

    # ---- the search ---------------------------------------------------------

    def matches(self, points: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: places where a piece of that length begins, and its node.  ``ends``: where each place's text ends."""
        out = []
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for n in range(self.longest):
            live = at + n < ends[at]
            at, node = at[live], node[live]
            found = self.children.get_indexer(node << 21 | points[at + n])
            live = found >= 0
            at, node = at[live], self.child_node[found[live]]
            whole = self.node_id[node] >= 0
            out.append((at[whole], node[whole]))
            if not len(at):
                break
        return out

    def search(self, texts: list[str], starts: list[int] | None = None, entry: list[np.ndarray] | None = None) -> tuple:
        """Forward scores of all texts at once: best, back (start of the best last piece), first place of each text.

        Pieces begin only at the first ``starts`` places of a text (default:
        all).  ``entry``: scores of the first places before any piece (default:
        0 at the first).  Every text has one place more than characters.
        """
        n = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(n + 1) - (n + 1)
        total = int((n + 1).sum())
        points = np.zeros(total, np.int64)
        where = np.ones(total, bool)
        where[first + n] = False
        points[where] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts)), n + 1)
        best = np.full(total, LOWEST)
        back = np.full(total, -1, np.int64)
        if entry is None:
            best[first] = 0.0
        else:
            for f, e in zip(first, entry):
                best[f:f + len(e)] = e
        stop = first + (n if starts is None else np.minimum(np.array(starts, np.int64), n))
        found = self.matches(points, (first + n)[text])
        single = np.zeros(total, bool)
        single[found[0][0]] = True
        lone = np.flatnonzero(where & ~single)
        steps = [(at, np.full(len(at), k + 1), self.node_score[node]) for k, (at, node) in enumerate(found)]
        steps.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.unknown)))
        at, size, score = (np.concatenate(c) for c in zip(*steps))
        own = at < stop[text[at]]
        at, size, score = at[own], size[own], score[own]
        # One round for each place within its text; within a round, one length after the other.
        place = at - first[text[at]]
        order = np.lexsort((size, place))
        at, size, score, place = at[order], size[order], score[order], place[order]
        key = place * (self.longest + 1) + size
        borders = np.flatnonzero(np.diff(key, prepend=-1))
        for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(key)]):
            s = at[a:b]
            e = s + size[a]
            got = best[s] + score[a:b]
            better = got > best[e]
            s, e = s[better], e[better]
            best[e], back[e] = got[better], s
        return best, back, first

    def trace(self, text: str, back: np.ndarray, first: int, end: int) -> tuple[bytes, int]:
        """The ids of the best pieces up to place ``end`` of a text, and the place where they begin."""
        ids: list[int] = []
        at = first + end
        while back[at] >= 0:
            start = int(back[at])
            ids.extend(reversed(self.ids_of(text[start - first:at - first])))
            at = start
        ids.reverse()
        return array("I", ids).tobytes(), at - first

    def ids_of(self, piece: str) -> tuple[int, ...]:
        i = self.id.get(piece)
        return (i,) if i is not None else tuple(self.byte[b] for b in piece.encode("utf-8", "replace"))

    # ---- whole texts --------------------------------------------------------

    def escaped(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def split(self, escaped: str) -> list[str]:
        return PARTS.findall(escaped) if self.cuts else [escaped]

    def learn(self, parts: set[str]) -> None:
        """Search the parts that are not known, and keep their ids and scores."""
        new = [p for p in parts if p not in self.known]  # a difference with the keys would visit all of them
        if len(self.known) + len(new) > self.kept:
            self.known = {p: self.known[p] for p in parts if p in self.known}
        for s in batches(new, 200_000):
            own = new[s]
            best, back, first = self.search(own)
            for p, f in zip(own, first.tolist()):
                self.known[p] = (self.trace(p, back, f, len(p))[0], float(best[f + len(p)]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """The ids (little-endian u32) and the score of each text."""
        cut = [self.split(self.escaped(t)) for t in texts]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        out = []
        for parts in cut:
            got = [get(p) for p in parts]
            out.append((b"".join([i for i, _ in got]), sum([s for _, s in got])))
        return out

    # ---- chunks of giant texts ------------------------------------------------

    def bounds(self, chunk: str, size: int) -> tuple[int, int]:
        """The first place (from L on) and the last (up to ``size``) that no piece lies across; 0, 0 if there is none."""
        if not self.cuts:
            return 0, 0
        found = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", chunk[:size])]
        found = [p for p in found if p >= self.longest]
        return (found[0], found[-1]) if found else (0, 0)

    def matrix(self, chunk: str, skip: int, size: int, last: bool) -> np.ndarray:
        """Best scores from each state at the start of a chunk to each at its end.

        ``chunk`` holds L - 1 characters more than its ``size``, as far as the text has them.
        """
        L = self.longest
        a, b = self.bounds(chunk, size)
        states = min(L, len(chunk) + 1)

        def ends(best: np.ndarray, first: int, at: int, length: int) -> np.ndarray:
            out = np.full(L, LOWEST)
            got = best[first + at:first + min(length, at + L - 1) + 1]
            out[:len(got)] = got[:1] if last else got
            if last:
                out[1:] = LOWEST
            return out

        out = np.full((L, L), LOWEST)
        if b:
            heads = [chunk[j:a] for j in range(states)]
            best, _, first = self.search(heads)
            head = np.array([best[f + len(h)] for h, f in zip(heads, first)])
            parts = self.split(chunk[a:b])
            self.learn(set(parts))
            middle = sum(self.known[p][1] for p in parts)
            tail = chunk[b:]
            best, _, first = self.search([tail], [size - b])
            out[:states] = head[:, None] + (middle + ends(best, int(first[0]), size - b, len(tail)))[None, :]
            return out
        rests = [chunk[j:] for j in range(states)]
        best, _, first = self.search(rests, [size - j for j in range(states)])
        for j, f in enumerate(first.tolist()):
            out[j] = ends(best, f, size - j, len(chunk) - j)
        return out

    def choices(self, chunk: str, skip: int, size: int, last: bool, entry: np.ndarray) -> tuple[bytes, list[tuple[int, bytes]]]:
        """The ids that all ways through a chunk share, and for each state at its end: the state it was entered by, and the ids after the shared ones."""
        L = self.longest
        a, b = self.bounds(chunk, size)
        own = entry[:min(L, len(chunk) + 1)]
        exits = [0] if last else range(min(L, len(chunk) - size + 1))
        if b:
            best, back, first = self.search([chunk[:a]], entry=[own[:a + 1]])
            head, came = self.trace(chunk[:a], back, int(first[0]), a)
            parts = self.split(chunk[a:b])
            self.learn(set(parts))
            shared = head + b"".join([self.known[p][0] for p in parts])
            tail = chunk[b:]
            best, back, first = self.search([tail], [size - b])
            return shared, [(came, self.trace(tail, back, int(first[0]), size - b + x)[0]) for x in exits]
        best, back, first = self.search([chunk], [size], [own])
        out = []
        for x in exits:
            ids, came = self.trace(chunk, back, int(first[0]), size + x)
            out.append((came, ids))
        return b"", out

    def forward(self, made: list[bytes]) -> tuple[list[bytes], float]:
        """The scores of the states at the start of each chunk, from the chunks' matrices in order, and the text's score."""
        L = self.longest
        reached = np.concatenate([np.full((1, L), LOWEST), scan(np.stack([np.frombuffer(m).reshape(L, L) for m in made]))[:, 0, :]])
        reached[0, 0] = 0.0  # a text begins in state 0
        return [r.tobytes() for r in reached[:-1]], float(reached[-1, 0])

    def entries(self, entered: bytes) -> np.ndarray:
        return np.frombuffer(entered)


def of_model(model) -> Vocabulary | Merges:
    """What encodes with a model, by its kind."""
    spec, kinds = model.normalizer_spec, type(model.pieces[0])
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models whose normalizer is the identity are supported")
    if sum(p.type == kinds.BYTE for p in model.pieces) != 256 or any(p.type == kinds.USER_DEFINED for p in model.pieces):
        raise ValueError("only models with byte pieces and without pieces of the user's own are supported")
    return Merges(model) if model.trainer_spec.model_type == model.trainer_spec.BPE else Vocabulary(model)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary | Merges:
    """One vocabulary for each Python worker."""
    return of_model(read_model(path))


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus products of two stacks of matrices, 256 at a time."""
    return np.concatenate([(a[i:i + 256, :, :, None] + b[i:i + 256, None, :, :]).max(axis=2) for i in range(0, len(a), 256)])


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... of a stack of matrices, in as many rounds as the logarithm of their number."""
    out, step = matrices, 1
    while step < len(out):
        out = np.concatenate([out[:step], product(out[:-step], out[step:])])
        step *= 2
    return out


def few(it: Iterator[pa.RecordBatch], most: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``most`` in a batch: chunks and their ids are large."""
    for batch in it:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (binary, little-endian u32), score of every row."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") > 2 * chunk

    def small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for s in batches(texts):
                got = vocabulary(path).encode(texts[s])
                yield pa.record_batch([batch.column(0).slice(s.start, s.stop - s.start), pa.array([i for i, _ in got], pa.binary()), pa.array([v for _, v in got], pa.float64())], ["doc_id", "ids", "score"])

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = vocabulary(path)
                own, more = v.escaped(text), v.longest - 1  # so far a piece may reach over the border
                if chunk < v.longest:
                    raise ValueError(f"a chunk must have {v.longest} characters at least")
                key = TaskContext.get().partitionId() << 33 | n
                n += 1
                starts = range(0, len(own), chunk)
                for at in range(0, len(starts), 256):
                    some = starts[at:at + 256]
                    k = len(some)
                    yield pa.record_batch([pa.array([key] * k, pa.int64()), pa.array([doc] * k, pa.int64()), pa.array(range(at, at + k), pa.int32()), pa.array([min(chunk, len(own) - s) for s in some], pa.int32()),
                                           pa.array([s + chunk >= len(own) for s in some], pa.bool_()), pa.array([min(s, v.before) for s in some], pa.int32()),
                                           pa.array([own[max(0, s - v.before):s + chunk + more] for s in some], pa.string())],
                                          ["key", "doc_id", "chunk", "size", "last", "skip", "text"])

    chunks = stored(rows.filter(giant).mapInArrow(split, "key long, doc_id long, chunk int, size int, last boolean, skip int, text string").repartition("key", "chunk"), "chunks")

    def transfer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(it):
            made = [vocabulary(path).matrix(t, k, n, z).tobytes() for n, z, k, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["key", "chunk", "matrix"])

    def forward(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for key, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entered, score = vocabulary(path).forward([i["matrix"] for i in items])
                yield pa.record_batch([pa.array([key] * len(items), pa.int64()), pa.array([i["chunk"] for i in items], pa.int32()), pa.array(entered, pa.binary()),
                                       pa.array([score] * len(items), pa.float64())], ["key", "chunk", "entry", "score"])

    def ways(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(it):
            came, shared, after = [], [], []
            for n, z, k, t, e in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
                v = vocabulary(path)
                common, own = v.choices(t, k, n, z, v.entries(e))
                shared.append(common)
                came.append([c for c, _ in own])
                after.append([i for _, i in own])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(7), pa.array(came, pa.list_(pa.int32())), pa.array(shared, pa.binary()), pa.array(after, pa.list_(pa.binary()))],
                                  ["key", "chunk", "score", "came", "shared", "after"])

    def taken(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for key, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state, out = 0, []
                for i in reversed(items):
                    out.append(state)
                    state = i["came"][state]
                yield pa.record_batch([pa.array([key] * len(items), pa.int64()), pa.array([i["chunk"] for i in items], pa.int32()), pa.array(out[::-1], pa.int32())], ["key", "chunk", "state"])

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc, score, items in zip(*(batch.column(i) for i in range(3))):
                ids = b"".join(items.values.field(1).to_pylist())
                own = vocabulary(path).sum(ids) if vocabulary(path).after_text else score.as_py()
                yield pa.record_batch([pa.array([doc.as_py()], pa.int64()), pa.array([ids], pa.binary()), pa.array([own], pa.float64())], ["doc_id", "ids", "score"])

    def of_text(df: DataFrame, value: str) -> DataFrame:
        """A text's chunks in order: a few numbers for each, far less than the text itself."""
        return df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", value))).alias("items"))

    matrices = chunks.select("key", "chunk", "size", "last", "skip", "text").mapInArrow(transfer, "key long, chunk int, matrix binary")
    entries = of_text(matrices, "matrix").mapInArrow(forward, "key long, chunk int, entry binary, score double")
    through = chunks.join(entries, ["key", "chunk"]).select("key", "chunk", "size", "last", "skip", "text", "entry", "score")
    found = stored(through.mapInArrow(ways, "key long, chunk int, score double, came array<int>, shared binary, after array<binary>"), "ways")
    states = of_text(found.select("key", "chunk", "came"), "came").mapInArrow(taken, "key long, chunk int, state int")
    ids = found.join(states, ["key", "chunk"]).select("key", "chunk", "score", F.concat("shared", F.get("after", "state")).alias("ids"))
    whole = ids.groupBy("key").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("items"))
    names = chunks.filter("chunk = 0").select("key", "doc_id")
    long = whole.join(names, "key").select("doc_id", "score", "items").mapInArrow(joined, "doc_id long, ids binary, score double")
    return rows.filter(~giant).mapInArrow(small, "doc_id long, ids binary, score double").unionByName(long)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with a column ``ids``) with the text that the ids stand for as ``decoded``."""
    names = encoded.columns
    at = names.index("ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [decoder(path).decode(i.as_py() or b"") for i in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")
