"""Each operator against a plain restatement, with the odd cases its docstring names."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from reviewcap.llm import bpe, chat, components, exact_dedup, fingerprints, huffman, language_id, ngram_join, packing, pieces, sharding, url_filter

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [
    (1, "same text"), (2, None), (3, ""), (4, "same text"), (5, "A b\tc\nd e  f\x0bg"), (None, "no id"), (7, LONG),
    (8, LONG + " end"), (9, "Grüße, 日本語 ☃ <|endoftext|> </s>[INST]"), (10, " "), (11, "x" * 5000), (4, "same text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("keep_id", "recipe", "digest", "tie", "n", "k1", "key", "part", "rank", "ids", "curve")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -99")


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts_of(n, seed=0):
    """Documents, copies and near copies."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(300)]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            own = r.choice(out).split(" ")
            for _ in range(r.choice([0, 1, 2, 6])):
                own[r.randrange(len(own))] = r.choice(words)
        else:
            own = [r.choice(words) for _ in range(r.choice([1, 3, 4, 30, 80]))]
        out.append(" ".join(own))
    return out


# --- 1: exact dedup ---------------------------------------------------------
def dedup_expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], brute.sha(t or "")) for i, t in pairs), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, odd, weak):
    hashed = (lambda c: F.length(c).cast("long") % 3) if weak else F.xxhash64  # three identifiers: nearly all collide
    got = exact_dedup.exact_duplicates(odd, hashed=hashed)
    assert sorted(rows(got), key=str) == dedup_expected(ODD)
    many = [(i, t) for i, t in enumerate(texts_of(60))]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(many, "doc_id long, text string"), least=8, most=16, hashed=hashed)
    assert sorted(rows(got), key=str) == dedup_expected(many)


def test_exact_duplicates_rows(odd, none):
    kept = exact_dedup.without_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 4, 4, 5, None, 7, 8, 9, 10, 11]))
    assert rows(exact_dedup.exact_duplicates(none)) == []


def test_chunks_are_the_text(odd):
    c = exact_dedup.chunks(F.coalesce("text", F.lit("")), 64, 256)
    bad = odd.filter(F.array_join(c, "") != F.coalesce("text", F.lit(""))).count()
    assert bad == 0
    assert odd.select(F.max(F.array_max(F.transform(c, F.length))).alias("m")).first().m <= 257


# --- 2: pieces ----------------------------------------------------------------
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces and scores, marked as a unigram model."""
    model = pieces.read_model(PIECES)
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def library_ids(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode


def some_texts():
    r = random.Random(5)
    alphabets = ["ab  eéth日☃ \n", "etaoinsrh", "ab", "e ", "日本語中国a", "0123456789", "<>/=\"' divclass", ".,;:-_=*# ", "etaoin shrdlu ▁\x00"]
    return ["", " ", "a  b", "the attention of the", "日本語☃", "a▁b", "\n\n x", "x" * 300, " " * 37, "hello world"] + [
        "".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(1, 60))) for _ in range(60)] + ["".join(r.choice(a) for _ in range(r.randint(1, 80))) for a in alphabets for _ in range(30)]


def test_unigram_search_is_the_best_segmentation(unigram):
    v = pieces.vocabulary(unigram)
    own = {p: float(v.node_score[np.flatnonzero(v.node_id == i)[0]]) for p, i in v.id.items()}
    some = some_texts()
    for text, (ids, score) in zip(some, v.encode(some)):
        found, best = brute.viterbi(v.escaped(text), own, v.unknown)
        assert (np.frombuffer(ids, np.uint32).tolist(), score) == ([i for p in found for i in v.ids_of(p)], best)
        assert pieces.decoder(unigram).decode(ids) == text.replace("▁", " ")


def test_bpe_pieces_are_those_of_the_library():
    v, ids_of, some = pieces.vocabulary(PIECES), library_ids(PIECES), some_texts()
    for text, (ids, score) in zip(some, v.encode(some)):
        want = ids_of(text)
        assert np.frombuffer(ids, np.uint32).tolist() == want
        assert score == sum(v.score[i] for i in want)
        assert pieces.decoder(PIECES).decode(ids) == text.replace("▁", " ")
        own = v.escaped(text)
        if own:  # the lattice has one way through the text, and it is the library's
            reach, came = v.walk(own, len(own), [(0, 0)])
            assert [v.back(own, came, (len(own), n))[0] for n in reach[len(own)]] == [want]


def test_models_of_the_wrong_kind_are_refused():
    model = pieces.read_model(PIECES)
    with pytest.raises(ValueError):
        pieces.Vocabulary(model)
    model.trainer_spec.model_type = model.trainer_spec.WORD
    with pytest.raises(ValueError):
        pieces.of_model(model)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_piece_chunks_give_the_whole_search(spark, odd, none, unigram, kind):
    path = PIECES if kind == "bpe" else unigram
    v = pieces.vocabulary(path)

    def whole(text):
        return np.array(library_ids(PIECES)(text), np.uint32).tobytes() if kind == "bpe" else v.encode([text])[0][0]

    got = {(r.doc_id, r.decoded): r for r in pieces.decode_pieces(pieces.encode_pieces(odd, path, chunk=64), path).collect()}
    assert len(got) == len(set((i, t or "") for i, t in ODD))
    for i, t in ODD:
        assert (bytes(got[i, t or ""].ids), got[i, t or ""].score) == (whole(t or ""), v.encode([t or ""])[0][1])
    assert rows(pieces.encode_pieces(none, path)) == []
    r = random.Random(7)
    hard = ["".join(r.choice(a) for _ in range(n)) for a in ("eatinors", "ab", " e", "日本語中国a", "=-", "☃\n\x00x") for n in (40, 41, 129, 600, 1000)] + [" " * 333, "a" * 700]
    out = pieces.encode_pieces(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"), path, chunk=20).collect()
    assert sorted((x.doc_id, bytes(x.ids)) for x in out) == [(i, whole(t)) for i, t in enumerate(hard)]


# --- 3: chat --------------------------------------------------------------------
def test_chat_round_trip(spark):
    turns = [
        (1, 2, "assistant", "a <|end|> b"), (1, 1, "user", "<\\|turn|> [INST]"), (1, 3, "assistant", None), (1, 4, None, "x</s>"),
        (2, None, "assistant", "\\<s>"), (2, 1, "<|text|>", "[\\\\/INST] <<SYS>> <</SYS>>"), (None, 1, "user", ""), (3, 1, "user", "tie b"), (3, 1, "user", "tie a"),
        (3, 1, "user", "tie a"), (4, 1, "assistant", LONG),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(0), "segments": F.lit(0), "loss": F.lit(0)})
    made = chat.format_chat(df)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", "segments", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(t[2] or "", t[3] or "") for t in own]
        assert r.loss == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        blocks = 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(own, own[1:]))
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == blocks
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
    spans = {(r.conv_id, r.start, r.end) for r in chat.loss_spans(made).collect()}
    assert "".join(got[1].formatted[a:b] for c, a, b in sorted(x for x in spans if x[0] == 1)) == chat_escaped("a <|end|> b")
    assert rows(chat.format_chat(df.filter("conv_id = -9"))) == []


def chat_escaped(text):
    import re
    return re.sub(rf"([<\[])(\\*)({chat.CONTROL})", r"\1\\\2\3", text)


# --- 4: language ------------------------------------------------------------------
def test_language_id(spark):
    r = random.Random(1)
    words = {"en": ["the", "of", "and", "thing", "ing", "shall"], "fr": ["les", "eau", "aux", "être", "ment", "qui"], "de": ["der", "ung", "schaft", "über", "nicht", "zu"]}
    docs = [(i, " ".join(r.choice(words[c]) for _ in range(r.choice([1, 5, 60]))), c, "src") for i, c in enumerate(r.choice(list(words)) for _ in range(240))]
    docs += [(1000, None, "en", "src"), (1001, "123 !!! ---", "en", "src"), (1002, "日本語 日本語 漢字 漢字 日本語" * 5, None, None), (None, "the thing and the thing", None, None), (0, docs[0][1], docs[0][2], "src")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({"key": F.lit(0), "evidence": F.lit(0)})
    pages = spark.createDataFrame([(i, f"https://www.{c}.example.org/{c}/{i}?x=1", f'<html class=a lang="{c}">') for i, (_, _, c, _) in enumerate(docs[:100])] + [(500, None, None), (501, "junk", "<html>"), (502, "https://a/en/1000", None)],
                                  "page_id long, url string, html string")
    got = language_id.identify(df, language_id.page_evidence(pages)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    truth = {i: c for i, _, c, _ in docs[:240]}
    assert sum(by[i].lang == c for i, c in truth.items()) >= 0.97 * len(truth)
    assert sum(by[i].kept for i in truth) >= 0.97 * len(truth)
    assert not by[1000].kept and not by[1001].kept and not by[1002].kept and by[1002].lang == "und"
    assert by[None].lang == "en" and by[5].declared == truth[5]
    assert len(language_id.identified(df, language_id.page_evidence(pages)).columns) == len(df.columns)
    assert rows(language_id.identify(df.filter("doc_id = -1"), language_id.page_evidence(pages))) == []
    unlabelled = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), language_id.page_evidence(pages))
    assert not any(r.kept for r in unlabelled.collect())


def test_rare_language_is_known_at_any_size(spark):
    """40 of 8040 labelled documents make a language, though few are among the 400 smallest hashes; 4 do not."""
    r = random.Random(2)
    words = {"en": ["the", "of", "and", "thing", "shall"], "fr": ["les", "eau", "aux", "ment", "qui"], "is": ["það", "og", "þegar", "veður", "maður"], "xx": ["zzqq", "qqzz"]}
    labels = ["en"] * 4000 + ["fr"] * 4000 + ["is"] * 40 + ["xx"] * 4
    docs = [(i, " ".join(r.choice(words[c]) for _ in range(30)), c, "src") for i, c in enumerate(labels)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert language_id.fit(df.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")), 400)[0] == ["en", "fr", "is"]
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    got = {x.doc_id: x for x in language_id.identify(df, language_id.page_evidence(pages), sample=400).collect()}
    assert all(got[i].lang == c and got[i].kept for i, _, c, _ in docs if c == "is")
    assert sum(got[i].lang == c for i, _, c, _ in docs) >= 0.99 * len(docs)


# --- 5: shards --------------------------------------------------------------------
@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    points = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**j) % side).alias(f"d{j}") for j in range(dims)])
    order = points.select("*", sharding.curve_index([F.col(f"d{j}") for j in range(dims)], bits).alias("i")).orderBy("i").collect()
    assert [r.i for r in order] == list(range(side**dims))
    assert all(sum(abs(a[f"d{j}"] - b[f"d{j}"]) for j in range(dims)) == 1 for a, b in zip(order, order[1:]))


def test_shards(spark, odd, none, tmp_path):
    import zlib
    placed = sharding.hilbert_shards(odd.withColumn("lang", F.when(F.col("doc_id") > 3, "en")), ["lang", "doc_id"], 5)
    got = placed.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert [r.shard for r in sharding.hilbert_shards(odd.limit(2), ["doc_id"], 7).collect()] in ([0, 1], [1, 0])
    assert rows(sharding.hilbert_shards(none, ["doc_id"], 5)) == []
    sharding.write_shards(odd.filter("doc_id > 4"), placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == odd.filter("doc_id > 4").count()


def test_shards_order_by_the_whole_text(spark):
    """Values that share a long beginning still get levels of their own."""
    docs = [(i, f"text {i}", f"https://www.example.org/{'abcd'[i % 4]}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r.shard for r in sharding.hilbert_shards(df, ["source"], 4).collect()}
    assert all(len({got[i] for i, _, v in docs if v == source}) == 1 for source in {v for _, _, v in docs})
    assert len(set(got.values())) == 4


# --- 6: URLs ----------------------------------------------------------------------
def test_url_rules_and_reputation(spark):
    urls = [
        ("HTTP://Example.ORG/es/x?y", "example.org", "/es/x", "example.org/es/", "block"), ("https://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.example.org/en/2#f", "a.example.org", "/en/2", "org/", "allow"), ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), ("http://x.com/FR/", "x.com", "/FR/", None, "allow"),
        ("http://org", "org", "", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://?q", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] + [(0, urls[0][0])], "page_id long, url string").withColumns({"host": F.lit("z"), "rule": F.lit("z"), "bad": F.lit(None).cast("int"), "n": F.lit(5)})
    got = url_filter.judge_pages(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *u[1:]) for i, u in enumerate(urls)] + [(0, *urls[0][1:])], key=str)
    assert rows(url_filter.judge_pages(df.filter("page_id < 0"))) == []
    # A host with many bad pages is blocked; one bad page on another is shrunk to its domain and is not.
    labelled = [(i, f"http://spam.a.net/{i}", 1) for i in range(60)] + [(100 + i, f"http://good{i % 7}.b.net/{i}", int(i % 20 == 0)) for i in range(140)] + [(500, "http://once.b.net/1", 1), (501, "http://spam.a.net/none", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(spark.createDataFrame(labelled, "page_id long, url string, bad int")).collect()}
    assert all(got[i] == "block" for i in [*range(60), 501]) and all(v == "allow" for i, v in got.items() if 100 <= i <= 500)


# --- 7, 10: ids --------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    r = random.Random(2)
    some = [t or "" for _, t in ODD] + ["  a", "a\n b", "a \n b", "don't  stop\n\nnow", "x\u00a0 y", "A\x1c b", "Élan ÀÉ ß", "end \n", "q\n.\nB", "e\u0301 e\u0301", "a! !b ...c"]
    some += ["".join(r.choice([" ", "\n", "a", "B", "é", "'", "s", ".", "1", "\t", "\u00a0", "日", "!", "  "]) for _ in range(30)) for _ in range(400)]
    made = bpe.Encoder(bpe.vocabulary_path(name), kept=200)
    got = [x for i in range(0, len(some), 50) for x in made.encode(some[i:i + 50])]
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [brute.tokenizer(name).encode(t, add_special_tokens=False).ids for t in some]


def test_huffman_codes():
    r = np.random.default_rng(1)
    for n, vocabulary in ((1, 1), (5, 2), (511, 5), (513, 300), (20_000, 40_000)):
        ids = np.minimum((r.pareto(0.7, n) * 3).astype(np.int64), vocabulary - 1).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids))
        assert lengths.max() <= huffman.MAX_BITS and sum(2.0 ** -int(x) for x in lengths if x) <= 1
        stream, offsets = huffman.encode_ids(ids, huffman.canonical(lengths), lengths)
        sizes = np.array([min(huffman.BLOCK, n - i) for i in range(0, n, huffman.BLOCK)])
        table = huffman.decode_table(lengths)
        assert (huffman.decode_blocks(stream, offsets, sizes, table) == ids).all()
        assert (huffman.decode_blocks(stream, offsets[-1:], sizes[-1:], table) == ids[(len(sizes) - 1) * huffman.BLOCK:]).all()
    short = huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), max_bits=4)
    assert short.max() == 4 and sum(2.0 ** -int(x) for x in short) == 1


def test_token_files(odd, none):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    got = huffman.read_token_files(huffman.write_token_files(huffman.token_ids(odd, path, 0))).collect()
    want = [(i, brute.ids_of("byte_bpe_50k.json", t, 0)) for i, t in ODD]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), brute.crc(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert rows(huffman.read_token_files(huffman.write_token_files(huffman.token_ids(none, path, 0)))) == []


def test_packing(odd, none):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    for window in (64, 4096):
        got = packing.pack(odd, path, 2, window).collect()
        want = sorted((str(i), tuple(brute.ids_of("word_bpe_49k.json", t, 2))) for i, t in ODD)
        spans = {}
        for r in got:
            own = np.frombuffer(bytes(r.ids), np.uint32).tolist()
            assert len(own) == r.length
            spans.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, own))
        seen = sum(len(p) for s in spans.values() for _, p in s)
        assert seen == sum(len(x) for _, x in want)
        for doc, ids in set(want):
            copies = want.count((doc, ids))
            at = sorted((s, p) for s, p in spans[doc, len(ids)] if p == list(ids[s:s + len(p)]))
            assert sum(len(p) for _, p in at) >= copies * len(ids)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(by) == list(range(len(by)))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at == window or at & (at - 1) == 0
    assert rows(packing.pack(none, path, 2)) == []


def test_fill_is_the_best_sum():
    from itertools import product
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 20): r.randint(0, 3) for _ in range(4)}
        target = r.randint(1, 60)
        got = packing.fill(counts, target)
        sums = [sum(n * k for n, k in zip(counts, ks)) for ks in product(*[range(c + 1) for c in counts.values()])]
        assert all(k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= target)


# --- 8: n-gram join ------------------------------------------------------------------
@pytest.mark.parametrize("k,percent,seed", [(4, 85, 0), (5, 80, 1), (2, 50, 2)])
def test_ngram_join(spark, k, percent, seed):
    many = [(i * 3, t) for i, t in enumerate(texts_of(150, seed))]
    got = ngram_join.ngram_join(spark.createDataFrame(many, "doc_id long, text string"), k=k, percent=percent).collect()
    want = brute.joined(many, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: v[:2] for i, v in want.items()}
    assert sum(v[2] for v in want.values()) >= 40


def test_ngram_join_odd(odd, none):
    got = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_join(odd, k=4, percent=85).collect()))
    n = {i: len(brute.shingles(t, 4)) for i, t in ODD}
    comp = {1: 1, 4: 1, 7: 7, 8: 7}
    assert got == sorted((str(i), n[i], str(comp.get(i, i))) for i, _ in ODD)
    assert rows(ngram_join.ngram_join(none)) == []
    assert sorted(str(r.doc_id) for r in ngram_join.without_near_duplicates(odd).collect()) == sorted(str(i) for i, _ in ODD if i not in (4, 8))


def test_ngram_join_counts_every_link(spark):
    """Near copies that share their smallest hashes, and copies of each: all links count, also within a known component."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    near = [" ".join(base[:j] + [f"new{j}"] + base[j + 1:]) for j in r.sample(range(200), 14)]
    many = list(enumerate(near + near[:4] + texts_of(40, 3)))
    df = spark.createDataFrame(many, "doc_id long, text string")
    want = brute.joined(many, 4, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.ngram_join(df, k=4, percent=85).collect()} == want
    assert min(want[i][2] for i in range(14)) > 10
    classes, counts = ngram_join.classified(df, 4)[1:]
    links = ngram_join.class_links(df, classes, counts, 4, 85)
    named = classes.select("node", "least")
    got = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.least("x", "y"), F.greatest("x", "y"))
    sets = {}
    for i, t in many:
        sets.setdefault(frozenset(brute.shingles(t, 4)), i)
    sets = {i: x for x, i in sets.items()}
    assert sorted(rows(got)) == sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))


def test_ngram_join_links_match_sql(spark):
    from compare import compare
    from conftest import SF001
    r = compare(ngram_join.ngram_join(spark.read.parquet(f"{SF001}/documents.parquet"), k=4, percent=85), ngram_join.LINKS_ORACLE, SF001)
    assert r["cols_match"] and r["hash_match"] and "n_links" in r["oracle"] and r["oracle"]["n_links"].sum() > 0


REPEATED = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, "no id at all in this text"), (None, "no id at all in this text"),
            (2, "another text with its own words"), (2, "a second text of the same id here"), (2, "A second text of the  same id here"), (3, "another text with its own words"), (5, "")]


def test_one_row_of_each(spark):
    """A batch loaded twice and rows without ids: one row of each text and of each component stays."""
    df = spark.createDataFrame(REPEATED, "doc_id long, text string").withColumn("extra", F.lit(1))
    exact = exact_dedup.one_of_each(df)
    assert exact.columns == df.columns
    keep = {}
    for i, t in REPEATED:
        keep[t] = max([x for x in (i, keep.get(t)) if x is not None], default=None)
    assert sorted((r.text, str(r.doc_id)) for r in exact.collect()) == sorted((t, str(i)) for t, i in keep.items())
    near = ngram_join.without_near_duplicates(df)
    assert near.columns == df.columns
    got = sorted((str(r.doc_id), r.text.lower().replace("  ", " ")) for r in near.collect())
    assert got == sorted([("1", REPEATED[0][1]), ("None", REPEATED[3][1]), ("2", REPEATED[5][1]), ("2", REPEATED[6][1]), ("5", "")])


def test_components_of_chains_and_stars(spark, monkeypatch):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(1000, 1600)] + [(5000, i) for i in range(5001, 5400)] + [(r.randrange(300), r.randrange(300)) for _ in range(160)]
    links += [(9_000_000_000 + i, 7) for i in range(50)]
    links = [e for e in links if e[0] != e[1]]
    r.shuffle(links)
    low = {v: v for e in links for v in e}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    for parts in (1, 40):  # one task that makes all stars, and tasks that hold a few links each
        got = components.components(spark.createDataFrame(links, "a long, b long").repartition(parts))
        assert sorted((x.v, x.component) for x in got.collect()) == sorted(low.items())
    monkeypatch.setattr(components, "NODES", 3)
    assert sorted(e for b in components._stars([pa.record_batch([[4, 2, 9], [2, 1, 8]], ["a", "b"])]) for e in zip(*b.to_pydict().values())) == [(2, 1), (4, 1), (9, 8)]
    assert rows(components.components(spark.createDataFrame([], "a long, b long"))) == []


# --- 9: fingerprints -------------------------------------------------------------------
def test_winnowing(odd):
    got = {(r.doc_id, len(r.winnowed)): [(w.hash, w.position) for w in r.winnowed] for r in fingerprints.fingerprints(odd).collect()}
    for i, t in ODD:
        want = brute.winnowed(t or "")
        assert got[i, len(want)] == want


def test_against_edited(odd, none):
    got = fingerprints.against_edited(odd).collect()
    once = sorted(set((i, t or "") for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    want = {}
    for a, (i, t) in enumerate(once):
        nxt = once[(a + 1) % len(once)][1]
        tail = len(t) // 3
        edited = t[:len(t) - tail] + nxt[:tail]
        sets = [{h for h, _ in brute.winnowed(x)} for x in (t, edited, nxt)]
        near = [1.0 if not sets[0] | s else len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
        want[i, len(t)] = (brute.sha(edited), *near, " ".join(f"{h:x}@{p}" for h, p in brute.winnowed(t)))
    assert len(got) == len(ODD)
    for r in got:
        assert (r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) == want[r.doc_id, r.n_chars]
    assert rows(fingerprints.against_edited(none)) == []
