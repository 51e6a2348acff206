"""Encoders within a Python worker, and counts of ids as they are made."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import brute
from reviewcap.llm import bpe, huffman, ngram_join

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_words_are_kept_once(name):
    made = bpe.Encoder(bpe.vocabulary_path(name))
    text = "x hello hello, Éléphant éléphant; hello! (hello) a-b Ab"
    assert np.frombuffer(made.encode([text])[0], np.uint32).tolist() == brute.tokenizer(name).encode(text, add_special_tokens=False).ids
    assert "hello" in made.parts
    assert "Ġhello" not in made.tokens and all(len(t) < 6 for t in made.tokens if t.startswith("Ġ"))


def test_ids_are_counted_as_they_are_made(spark):
    name = NAMES[0]
    texts = ["a b a b", None, "", "hello world"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    made = huffman.token_ids(docs, bpe.vocabulary_path(name), 0)
    own = [x for t in texts for x in brute.ids_of(name, t, 0)]
    assert {r["id"]: r["n"] for r in huffman.id_counts(made).collect()} == Counter(own)
    assert made.filter("id IS NULL").count() == len(texts)


def test_other_stages_release_the_encoder():
    path = bpe.vocabulary_path(NAMES[0])
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array(["a b c d e"])], ["doc_id", "text"])
    bpe.encoder(path)
    assert len(list(ngram_join._sets(batch, 4))) == 1
    assert bpe.encoder.cache_info().currsize == 0
    bpe.encoder(path)
    bpe.encoder(bpe.vocabulary_path(NAMES[1]))
    assert bpe.encoder.cache_info().currsize == 1


# ---- F1, F2: many texts at once ---------------------------------------------------
SOME = ["", " ", "\n", ".", "a", "end \n", "a\n", "a\nb", "a.b,c", "4.0.\nTh", "it's. 'll\n's", "\0a b", "a \0b", "a\0.", "\u0130. b", "\u0130, b", "e\u0301. x", "\u0958. x", "a\u00a0.b",
        "Ça, été.\nÀ", "я. Я,", "日.日,", "a,.b", "a\r\nb", "(a) b!c", "<|endoftext|>. <|endoftext|>", "x" * 3000, "Σ. ς", "a. b , c", "a\u2028. b"]


@pytest.mark.parametrize("name", NAMES)
def test_bulk_ids_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(bpe, "MANY", 0)
    monkeypatch.setattr(bpe, "WORDS", 5)
    monkeypatch.setattr(bpe, "LONG", 2_000)
    r = random.Random(3)
    some = SOME + ["".join(r.choice("aZbé., \n'9#я\u0130-") for _ in range(r.randint(0, 14))) for _ in range(2_000)]
    made = bpe.Encoder(bpe.vocabulary_path(name))
    made.bulk.kept = 300
    got = [x for i in range(0, len(some), 100) for x in made.encode(some[i:i + 100])]
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [brute.tokenizer(name).encode(t, add_special_tokens=False).ids for t in some]
    assert 0 < sum(made.bulk.regular(some)) < len(some)


@pytest.mark.parametrize("name", NAMES)
def test_a_word_is_looked_up_once_beside_marks_and_line_ends(name):
    text = "x hello hello. hello, hello\nx hello.\nhello, hello " * 3_000
    made = bpe.Encoder(bpe.vocabulary_path(name))
    got = made.encode([text])
    assert np.frombuffer(got[0], np.uint32).tolist() == brute.tokenizer(name).encode(text, add_special_tokens=False).ids
    assert made.encode([text, text]) == got * 2  # nothing new
    assert not made.parts and sorted(p for p in made.bulk.parts.to_pylist() if "hello" in p) == ["\0hello", "hello"]


def test_documents_are_coded_together():
    r = np.random.default_rng(4)
    n = np.array([0, 1, 0, 700, 513, 512, 2, 0])
    ids = np.minimum((r.pareto(0.5, n.sum()) * 3).astype(np.int64), 60_000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids))
    codes = huffman.canonical(lengths)
    stream, sizes, starts = huffman.encode_documents(ids, n, codes, lengths)
    assert len(stream) == sizes.sum()
    for size, end, last, k in zip(sizes, np.cumsum(sizes), np.cumsum(n), n):
        own = ids[last - k:last]
        bits = "".join(f"{int(codes[i]):0{lengths[i]}b}" for i in own)
        assert stream[end - size:end] == int(bits.ljust(8 * int(size), "0") or "0", 2).to_bytes(int(size), "big")
        assert starts[last - k:last].tolist() == [0, *np.cumsum(lengths[own].astype(int)).tolist()][:k]


# ---- F3: classes that the first step of the near-copy search leaves to the join ------------
def test_near_copies_meet_enough_others(spark):
    n = 300
    same = {**{c: 7 for c in ngram_join.MINS}, **{c: 0 for c in ngram_join.SKETCHES}}
    kinds = ", ".join(f"{c} long" for c in ["node", "n", *same])
    classes = spark.createDataFrame([(i, 100, *same.values()) for i in range(n)], kinds)
    pairs = [(r.a, r.b) for r in ngram_join.near_pairs(classes, 85).collect()]
    met = Counter(x for p in pairs for x in p)
    # Where one pair of ten links, a class that meets 40 others is left without a link once in 70 times.
    assert len(set(pairs)) == len(pairs) <= ngram_join.ORDERS * ngram_join.NEXT * n
    assert len(met) == n and min(met.values()) >= 40
