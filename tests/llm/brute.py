"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import xxhash
from tokenizers import Tokenizer


@lru_cache
def tokenizer(name: str) -> Tokenizer:
    import public_tokenizers

    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True
    return made


def ids_of(name: str, text: str | None, end: int) -> list[int]:
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids: list[int]) -> int:
    return zlib.crc32(array("I", ids).tobytes())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, k: int) -> set:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def joined(rows: list[tuple], k: int, percent: int) -> dict:
    """id -> (number of shingles, component, links), for rows (id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j]
                 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen), len(links[i]))
    return out


def winnowed(text: str, k: int = 4, w: int = 16) -> list[tuple[int, int]]:
    """(31-bit hash, position) of the chosen k-grams, in order."""
    def pair(a: int, b: int) -> int:
        x = xxhash.xxh64_intdigest((a & (2**64 - 1)).to_bytes(8, "little"), seed=42)
        return xxhash.xxh64_intdigest((b & (2**64 - 1)).to_bytes(8, "little"), seed=x)

    words = [xxhash.xxh64_intdigest(m.encode(), seed=42) for m in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text.lower())]
    if not words:
        return []
    if len(words) < k:
        h = 42
        for x in words:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        grams = [h]
    else:
        grams, step = words, 1
        while step < k:
            grams = [pair(grams[i], grams[i + step]) for i in range(len(grams) - step)]
            step *= 2
    values = [g >> 33 for g in grams]
    out = []
    for a in range(max(len(values) - w + 1, 1)):
        window = values[a:a + w]
        low = min(window)
        at = a + max(i for i, v in enumerate(window) if v == low)
        if not out or out[-1][1] != at:
            out.append((low, at))
    return out


def viterbi(text: str, pieces: dict[str, float], unknown: float) -> tuple[list[str], float]:
    """The segmentation with the largest sum of scores; of equal ones the longest last piece, at every place."""
    longest = max(map(len, pieces))
    best: list[tuple[float, int]] = [(0.0, -1)]
    for e in range(1, len(text) + 1):
        found = (float("-inf"), -1)
        for s in range(max(0, e - longest), e):
            score = pieces.get(text[s:e], unknown if e - s == 1 else None)
            if score is not None and best[s][0] + score > found[0]:
                found = (best[s][0] + score, s)
        best.append(found)
    out, at = [], len(text)
    while at > 0:
        out.append(text[best[at][1]:at])
        at = best[at][1]
    return out[::-1], best[-1][0]
