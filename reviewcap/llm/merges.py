"""Pieces of a BPE model file, searched as ways through a lattice.

The library merges the best pair of neighbours until none is left.  Its
result is also the one way through the text in which each two neighbouring
pieces, encoded alone, stay as they are: pieces and pairs have the weight 0 or
minus infinity, so the search is a max-plus one over states (place, last
piece).  Which pairs stay is asked of the library and kept.

No merge crosses a place before a space mark that follows another character
(as the vocabulary allows).  The parts between such places, most of which come
again and again, go to the library once each; the lattice is walked where a
chunk's border cuts a part.

The states at a border are the pieces of the text that end there or lie
across it, as (characters beyond the border, length).  A chunk's matrix says
which states at its end are reached from which at its start; products of such
matrices are associative.  As the weights are 0 and minus infinity, a matrix is
kept as one byte an entry, and a product is that of counts, cut at one.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np

from .bpe import batches

SPACE = "▁"
PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")
SHORT = 64  # characters of a part that is kept
COMMON = 8  # characters of a part that is kept longest

State = tuple[int, int]  # characters beyond a border (or the place of the end), length of the piece


class Merges:
    """Encoding with a BPE model, of whole texts and of chunks."""

    after_text = True  # scores are summed once a text's ids are known

    def __init__(self, model, kept: int = 150_000):
        import sentencepiece

        spec = model.normalizer_spec
        kinds = type(model.pieces[0])
        self.prefix, self.kept = spec.add_dummy_prefix, kept
        own = type(model)()
        own.CopyFrom(model)
        own.normalizer_spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=own.SerializeToString())
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.score = np.array([p.score for p in model.pieces], np.float64)
        self.longest = self.before = max(map(len, self.id))
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.begins = {p[:n] for p in self.id for n in range(1, len(p) + 1)}
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode()]

    # ---- whole texts ----------------------------------------------------------

    def escaped(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts that are given as parts."""
        known = self.known
        new = [p for p in set().union(*texts) if p not in known]  # a difference with the keys would visit all of them
        if len(known) + len(new) > self.kept:  # short parts come most often
            wanted = set().union(*texts)
            short = sum(len(p) <= COMMON for p in known) < self.kept * 3 // 4
            self.known = {p: i for p, i in known.items() if p in wanted or short and len(p) <= COMMON}
        for s in batches(new):
            self.known.update(zip(new[s], [array("I", i).tobytes() for i in self.library.encode(new[s], num_threads=1)]))
        get = self.known.__getitem__
        out = [b"".join(map(get, parts)) for parts in texts]
        for p in new:
            if len(p) > SHORT:
                del self.known[p]
        return out

    def split(self, escaped: str) -> list[str]:
        return PARTS.findall(escaped) if self.cuts else [escaped] if escaped else []

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """The ids (little-endian u32) and the sum of their scores, for each text."""
        return [(i, self.sum(i)) for i in self.ids([self.split(self.escaped(t)) for t in texts])]

    def sum(self, ids: bytes) -> float:
        return float(self.score[np.frombuffer(ids, np.uint32)].sum())

    # ---- the lattice ----------------------------------------------------------

    def stay(self, left: str, right: str) -> bool:
        """Whether two pieces (``left`` may be empty) stay as they are when their text is encoded alone."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.kept:
                self.pairs.clear()
            want = (self.ids_of(left) if left else []) + self.ids_of(right)
            found = self.pairs[left, right] = self.library.encode(left + right) == want
        return found

    def at(self, text: str, place: int) -> list[int]:
        """Lengths of the pieces that begin at a place (a character without a piece is one)."""
        out = [] if text[place] in self.id else [1]
        for n in range(1, min(self.longest, len(text) - place) + 1):
            own = text[place:place + n]
            if own not in self.begins:
                break
            if own in self.id:
                out.append(n)
        return out

    def states(self, text: str, border: int) -> list[State]:
        """The pieces of the text that end at the border or lie across it, in a fixed order."""
        out = []
        for start in range(max(0, border - self.longest), border):
            out += [(start + n - border, n) for n in self.at(text, start) if start + n >= border]
        return sorted(out)

    def walk(self, text: str, stop: int, entry: list[State]) -> tuple[dict, dict]:
        """All ways from the states ``entry`` (ends and lengths) with pieces that begin before ``stop``.

        Gives, for each end, the lengths of last pieces with the set of entries
        (bits) that reach them, and for each (end, length) the length of the piece before.
        """
        reach: dict[int, dict[int, int]] = defaultdict(dict)
        came: dict[State, int] = {}
        for bit, (end, n) in enumerate(entry):
            reach[end][n] = reach[end].get(n, 0) | 1 << bit
        for place in range(min((end for end, _ in entry), default=stop), stop):
            here = reach.get(place)
            if not here:
                continue
            for n in self.at(text, place):
                right = text[place:place + n]
                for m, who in here.items():
                    if self.stay(text[place - m:place], right):
                        there = reach[place + n]
                        if n not in there:
                            came[place + n, n] = m
                        there[n] = there.get(n, 0) | who
        return reach, came

    def back(self, text: str, came: dict, state: State) -> tuple[list[int], State]:
        """The ids of the way to a state, and the entry it began in."""
        out: list[list[int]] = []
        end, n = state
        while (end, n) in came:
            out.append(self.ids_of(text[end - n:end]))
            end, n = end - n, came[end, n]
        return [i for ids in reversed(out) for i in ids], (end, n)

    # ---- chunks of giant texts --------------------------------------------------

    def borders(self, text: str, skip: int, size: int, last: bool) -> tuple[list[State], list[State], int, int]:
        """States at the start and the end of a chunk that lies at ``skip``; the first (from L on) and last place in it that no piece lies across."""
        entry = self.states(text, skip) if skip else [(0, 0)]
        leave = [s for s in self.states(text, skip + size) if not last or s[0] == 0]
        found = [m.start() for m in CUT.finditer(text, skip, skip + size)] if self.cuts else []
        found = [p for p in found if p >= skip + self.longest]
        return entry, leave, found[0] if found else 0, found[-1] if found else 0

    def matrix(self, text: str, skip: int, size: int, last: bool) -> np.ndarray:
        """Which states at a chunk's end are reached from which at its start (1 for the weight 0).

        ``text`` holds ``skip`` characters before the chunk and up to L - 1 after it.
        """
        entry, leave, a, b = self.borders(text, skip, size, last)
        begin = [(skip + j, n) for j, n in entry]
        out = np.zeros((len(entry), len(leave)), np.uint8)
        if b:
            reach, _ = self.walk(text, a, begin)
            through = 0
            for who in reach[a].values():
                through |= who
            rest, _ = self.walk(text, skip + size, [(b, 0)])
            for k, (j, n) in enumerate(leave):
                if n in rest.get(skip + size + j, ()):
                    out[:, k] = [through >> i & 1 for i in range(len(entry))]
            return out
        reach, _ = self.walk(text, skip + size, begin)
        for k, (j, n) in enumerate(leave):
            who = reach.get(skip + size + j, {}).get(n, 0)
            out[:, k] = [who >> i & 1 for i in range(len(entry))]
        return out

    def choices(self, text: str, skip: int, size: int, last: bool, entered: np.ndarray) -> tuple[bytes, list[tuple[int, bytes]]]:
        """The ids that all ways share, and for each state at the end the state it was entered by (-1: not reached) and the ids after the shared ones.

        ``entered``: which states at the start are reached.  A piece across the end belongs to this chunk.
        """
        entry, leave, a, b = self.borders(text, skip, size, last)
        place = {(skip + j, n): i for i, (j, n) in enumerate(entry)}
        begin = [s for s, i in place.items() if entered[i]]
        end = skip + size
        reach, came = self.walk(text, a or end, begin)
        shared, origin = b"", -1
        if b:
            ids, origin_state = self.back(text, came, (a, next(iter(reach[a]))))
            origin = place[origin_state]
            shared = array("I", ids).tobytes() + self.ids([self.split(text[a:b])])[0]
            reach, came = self.walk(text, end, [(b, 0)])
        out = []
        for j, n in leave:
            if n in reach.get(end + j, ()):
                ids, first = self.back(text, came, (end + j, n))
                out.append((origin if b else place[first], array("I", ids).tobytes()))
            else:
                out.append((-1, b""))
        if last:
            out = [x for x in out if x[0] >= 0][:1]
        return shared, out

    def forward(self, made: list[bytes]) -> tuple[list[bytes], float]:
        """The states reached at the start of each chunk, from the chunks' matrices in order."""
        rows, matrices = 1, []
        for m in made:
            matrices.append(np.frombuffer(m, np.uint8).reshape(rows, -1))
            rows = matrices[-1].shape[1]
        reached = [np.ones((1, 1)), *products(matrices)[:-1]]  # a text begins in its only first state
        return [r[0].astype(np.uint8).tobytes() for r in reached], 0.0

    def entries(self, entered: bytes) -> np.ndarray:
        return np.frombuffer(entered, np.uint8)


def products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, in as many rounds as the logarithm of their number."""
    out, step = [m.astype(np.float32) for m in matrices], 1
    while step < len(out):
        out = out[:step] + [np.minimum(a @ b, 1) for a, b in zip(out[:-step], out[step:])]
        step *= 2
    return out
