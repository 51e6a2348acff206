"""Conversation repair, secret scan and filter audit against plain restatements."""

import base64
import bz2
import gzip
import itertools
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import brute
from compare import compare
from conftest import SF001, SF01
from reviewcap.llm import conversation_repair as repair
from reviewcap.llm import filter_audit, secret_scan

WHITE = re.compile(r"[^\x20\x09-\x0D]")


# --- 11: conversation repair --------------------------------------------------
def all_edits(rows):
    """Every (cost, audit, repaired lines) that makes (initial, role, text, fault) rows legal, two insertions in a place at most."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    out = []

    def go(i, last, cost, audit, lines, inserted):
        if i == len(rows) and last in ("", "a"):
            out.append((cost, audit, lines))
        if inserted < 2:
            for x in follow[last]:
                if x in name:
                    go(i, x, cost + 5, audit + "I", lines + (name[x] + ":",), inserted + 1)
        if i == len(rows):
            return
        initial, role, text, fault = rows[i]
        go(i + 1, last, cost + 2, audit + "D", lines, 0)
        if fault in ("blank", "duplicate"):
            return
        more = 5 if fault == "truncated" else 0
        if initial in follow[last] and initial:
            go(i + 1, initial, cost + more, audit + "K", lines + (role + ":" + text,), 0)
        for x in follow[last]:
            if x in name:
                go(i + 1, x, cost + 1 + more, audit + "R", lines + (name[x] + ":" + text,), 0)

    go(0, "", 0, "", (), 0)
    return out


def repaired(turns):
    """The result of each conversation of (conv_id, turn, role, text) rows, restated."""
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((turn is not None, turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), brute.sha(r[3])))
        seen, own, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in rows:
            letters = WHITE.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            own.append((role[:1], role, text, fault))
            if fault:
                counts[fault] += 1
        turn_numbers = [t for known, t, _, _ in rows if known]
        gaps = max(turn_numbers) - min(turn_numbers) + 1 - len(set(turn_numbers)) if turn_numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = min(all_edits(own))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, brute.sha("\n".join(lines)))
    return out


def repaired_by_operator(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("sha", "fault", "audit", "cost", "kind", "edit", "n")})
    found, edits = repair.repair(df)
    sha = {r.conv_id: r.repaired_sha256 for r in repair.digests(edits).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[r.conv_id]) for r in found.collect()}


def random_turns(n, seed):
    r = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["yes.", "no!", "what?", "cut off", " ", "", None, "x. \n", "y.\x0b", "a", " "]
    return [(conv if conv else None, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)) for conv in range(n) for _ in range(r.randint(1, 4))]


def test_repair_is_the_cheapest(spark):
    turns = random_turns(120, 3)
    assert repaired_by_operator(spark, turns) == repaired(turns)


def test_repair_long_conversation(spark):
    """A long conversation beside many short ones: the shared beginning is settled many times."""
    r = random.Random(5)
    turns = [(1, i, r.choice(["user", "assistant"]), r.choice(["one.", "two!", "cut", ""]) + ("" if i % 3 else f" {i}.")) for i in range(4000)]
    found, edits = repair.repair(spark.createDataFrame(turns + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string"))
    got = {x.conv_id: x for x in found.collect()}
    assert got[2].audit == "KK" and got[2].cost == 0
    rows = [x for x in edits.filter("conv_id = 1").collect()]
    kept = "".join(x.role[0] for x in rows if x.edit != "D")
    assert re.fullmatch("(ua)+", kept) and "".join(x.edit for x in rows) == got[1].audit
    assert sum(x.edit != "I" for x in rows) == 4000


def test_search_does_not_depend_on_settling_or_hashes():
    r = random.Random(9)
    for n in (0, 1, 2, 5, 40, 300):
        rows = [(r.choice("suat"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        results = set()
        for settle, modulus in ((1 << 30, repair.MODULUS), (8, repair.MODULUS), (1 << 30, 2), (50, 3)):
            s = repair.Search(settle, modulus)
            for initial, fault in rows:
                s.row(initial, fault)
            results.add(s.result())
        assert len(results) == 1


def test_audit_order_is_ascii_order():
    r = random.Random(1)
    for modulus in (1, 2, 5, repair.MODULUS):  # all hashes, or many, collide
        a = repair.Audits(modulus)
        nodes, strings = [0], [""]
        for _ in range(300):
            i = r.randrange(max(0, len(nodes) - 20), len(nodes))
            x = r.choice("DIKR" if r.random() < 0.3 else "K")
            nodes.append(a.longer(nodes[i], x))
            strings.append(strings[i] + x)
        for _ in range(2000):
            i, j = r.randrange(len(nodes)), r.randrange(len(nodes))
            assert a.less(nodes[i], nodes[j]) == (strings[i] < strings[j])


def test_repair_empty_table(spark):
    found, edits = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.collect() == [] and edits.collect() == [] and repair.digests(edits).collect() == []


def test_damage(spark, tmp_path):
    """The whole query on odd rows: every conversation is returned, dropped rows or not."""
    turns = random_turns(60, 8)
    folder = str(tmp_path)
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    hurt = []
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        hurt += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    want = dict.fromkeys({t[0] for t in turns}, (0, 0, 0, 0, 0, 0, "", brute.sha(""))) | repaired(hurt)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in E.queries()["op11_conversation_repair"](spark, folder).collect()}
    assert got == want


# --- 12: secret scan ------------------------------------------------------------
def plain_finds(text):
    """The patterns as given, with the words for letters of either case spelt out."""
    out = []
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % words, text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def percent(t):
    return "".join(f"%{b:02X}" for b in t.encode())


ENCODERS = {
    "url": lambda t: urllib.parse.quote(t, safe=""), "percent": percent, "escape": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "entity": lambda t: "".join(f"&#{ord(c)};" for c in t), "hexentity": lambda t: "".join(f"&#x{ord(c):X};" for c in t), "bytes": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(), "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "wrapped": lambda t: base64.encodebytes(t.encode()).decode().rstrip("\n"),
    **{n: (lambda t, f=f: base64.b64encode(f(t.encode())).decode()) for n, f in (("gzip", gzip.compress), ("zlib", zlib.compress), ("bz2", bz2.compress), ("xz", lzma.compress))},
    "raw": lambda t: "".join(f"%{b:02x}" for b in zlib.compress(t.encode())),
}
SECRETS = {"assign": 'password = "hunter22xyz"', "access": "AKIA" + "Q7" * 8, "hex": "deadbeef" * 4}


@pytest.mark.parametrize("name", sorted(ENCODERS))
def test_each_layer(name):
    for kind, secret in SECRETS.items():
        own = ENCODERS[name](f"see the note about {secret} and so on")
        text = f"Ünder the {own} tree"
        base, spans = secret_scan.scan(text)
        assert base == plain_finds(text)
        found = [s for s in spans if s[0] == kind]
        assert found, (name, kind)
        assert all(10 <= a < b <= 10 + len(own) for _, a, b in found)


def test_nested_layers():
    r = random.Random(4)
    for _ in range(150):
        kind = r.choice(sorted(SECRETS))
        own = f"about {SECRETS[kind]} now"
        for name in [r.choice([n for n in sorted(ENCODERS) if n not in ("bytes", "escape")]) for _ in range(r.randint(1, 4))]:
            if len(own) < 20_000:
                own = ENCODERS[name](own)
        text = "before it: " + own + " after it"
        _, spans = secret_scan.scan(text)
        assert any(s[0] == kind and 11 <= s[1] < s[2] <= 11 + len(own) for s in spans), text[:80]


def test_spans_name_the_encoded_characters():
    text = "tok%65n=abc%64efgh é \\u0070assword=ab\\x63defg"
    assert [(k, text[a:b]) for k, a, b in secret_scan.scan(text)[1]] == [("assign", "tok%65n=abc%64efgh"), ("assign", "\\u0070assword=ab\\x63defg")]
    inner = "xx token=abcdef123 yy"
    text = "é " + base64.b64encode(inner.encode()).decode()
    (kind, a, b), = secret_scan.scan(text)[1]
    # the groups of four that the first and the last character came from
    assert kind == "assign" and a == 2 + 3 * 8 // 6 and b == 2 + (18 * 8 - 1) // 6 + 1


def test_layers_end():
    assert secret_scan.scan("")[1] == [] and secret_scan.scan("%25" * 50)[1] == []
    bomb = base64.b64encode(zlib.compress(b"0" * 5000)).decode()
    assert secret_scan.scan(bomb, 1000)[1] == [("opaque", 0, len(bomb))]
    assert secret_scan.scan(bomb, 10_000)[1] == [("hex", 0, len(bomb))]
    assert secret_scan.scan(base64.b64encode(b"\x1f\x8b" + b"no stream at all" * 3).decode())[1] == []


def test_query_of_secrets(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, 'token: "abc"'), (3, "Secret=abcdef"), (None, "api_key='AKIA" + "Z" * 16 + "'"), (5, "x " * 50_000 + "f" * 24),
            (6, "TOKEN=a1b2c3 token=12345 passwd:=======")]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"base": F.lit(1), "spans": F.lit(2)}).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(str, E.queries()["op12_secret_scan"](spark, folder).collect()))

    def row(doc_id, text):
        own = plain_finds(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        n = [sum(k == x for x, _, _ in own) for k in ("assign", "access", "hex")]
        return f"Row(doc_id={doc_id}, n_assign={n[0]}, n_access={n[1]}, n_hex={n[2]}, base_sha256='{brute.sha(joined)}', spans='{joined}')"

    assert got == sorted(row(i, t) for i, t in docs)


def test_given_documents_keep_their_base(spark):
    """The base finds of the given table, restated; its clean documents have no others."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for r in E.queries()["op12_secret_scan"](spark, SF01).collect():
        own = plain_finds(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == brute.sha(joined) and r.spans == joined
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, _, _ in own) for k in ("assign", "access", "hex"))


# --- 13: filter audit -----------------------------------------------------------
def audited(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and i > first[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in quality, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, all_removed = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                all_removed[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(all_removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("limits", [{}, {"window_bytes": 300, "window_rows": 7, "range_bytes": 200}])
def test_filter_audit(spark, limits):
    r = random.Random(2)
    base = [" ".join(r.choice(["ab", "Cd", "é", "x#", "word", "other", "ABC"]) for _ in range(r.choice([0, 1, 5, 250]))) for _ in range(25)]
    base += ["same beginning " * 20 + str(i) for i in range(10)] + [" ".join(f"w{i}" for i in range(300)), None, "a", "ab", "abc", "é", "è"]
    docs = [(r.choice([None, *range(200)]), r.choice(base), r.choice(["en", "de", "", None])) for _ in range(300)]
    docs += [(1000 + i, "hot copy of a text", "en") for i in range(150)] + [(5, "x y", "fr"), (5, "x y", "fr")]
    labels = [(r.randrange(1200), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(400)] + [(None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "mask", "terminal", "n", "range", "least", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = filter_audit.failure_masks(df.repartition(3), **limits)
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.interactions(filter_audit.mask_counts(masks, marks)).collect()}
    assert got == audited(docs, labels)


def test_trie_and_cuts(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))).encode() for _ in range(300)]
    trie, want = filter_audit.TextTrie(), {}
    numbers = {}
    for i, t in enumerate(texts):
        n = trie.insert(t, 1000 - i)
        assert numbers.setdefault(t, n) == n
        want[t] = min(want.get(t, 10_000), 1000 - i)
    assert sorted(trie.terminals()) == list(range(len(want))) and {t: trie.least[n] for t, n in numbers.items()} == want
    many = [(f"common beginning {r.random()}",) for _ in range(400)]
    cuts = filter_audit.prefix_cuts(spark.createDataFrame(many, "text string").select(F.encode("text", "UTF-8").alias("text")), range_bytes=500)
    assert len(cuts) > 5 and cuts == sorted(set(cuts)) and all(len(c) < 30 for c in cuts)


def test_filter_audit_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_filter_audit"])
def test_matches_oracle(spark, name):
    r = compare(E.queries()[name](spark, SF001), E.oracle_sql()[name], SF001)
    assert r["cols_match"] and r["rows"][0] == r["rows"][1] and r["hash_match"]


# --- 8: what the order of shingles rests on ----------------------------------------
def test_frequent_shingles_are_kept():
    import numpy as np
    from reviewcap.llm import ngram_join
    r = np.random.default_rng(3)
    seen, true = ngram_join.Frequent(most=50), {}
    for i in range(400):
        own = np.unique(np.concatenate([r.integers(0, 10, 5), r.integers(1000, 10**9, 40)]).astype(np.uint64))
        for x in own.tolist():
            true[x] = true.get(x, 0) + 1
        seen.add(own)
        if i % 10 == 0:
            seen.merge()
    seen.merge()
    kept = dict(zip(seen.keys.tolist(), seen.counts.tolist()))
    lost = sum(true.values()) / 50
    assert len(kept) <= 50 and all(0 < n <= true[x] for x, n in kept.items())
    assert all(x in kept for x, n in true.items() if n > lost)


def test_components_of_the_query_equal_the_join(spark):
    from reviewcap.llm import ngram_join
    from test_llm_operators import ODD, texts_of
    many = [(i if i % 9 else None, t) for i, t in enumerate(texts_of(150, seed=4))] + ODD
    df = spark.createDataFrame(many, "doc_id long, text string")
    for k, percent in ((4, 85), (2, 50)):
        got = sorted(map(str, ngram_join.ngram_components(df, k=k, percent=percent).collect()))
        assert got == sorted(map(str, ngram_join.ngram_join(df, k=k, percent=percent).drop("n_links").collect()))


def test_sketches_never_differ_in_more_bits_than_the_sets():
    import numpy as np
    from reviewcap.llm import ngram_join
    r = np.random.default_rng(5)
    words = lambda own: np.array(ngram_join.parity_sketch(own), np.int64).view(np.uint8)
    for size in (0, 1, 40, 500, 20_000):
        for changed in (0, 1, 7, size // 10, size):
            x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            y = np.unique(np.concatenate([x[changed:], r.integers(0, 2**63, changed).astype(np.uint64)]))
            differ = int(np.unpackbits(words(x) ^ words(y)).sum())
            assert differ <= len(np.setxor1d(x, y)) and (differ > 0 or changed == 0 or size > 40)


def test_many_near_copies_are_one_component_as_links_say(spark):
    """Copies of one text, each with other edits: few pairs reach the threshold, and all links still count."""
    import random as rnd
    from reviewcap.llm import ngram_join
    r = rnd.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(80)] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(zip(*[t.split()[j:] for j in range(4)])) for i, t in rows}
    reach = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        shared = len(sets[i] & sets[j])
        if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
            a, b = sorted((reach[i], reach[j]))
            reach = {k: a if v == b else v for k, v in reach.items()}
    got = ngram_join.ngram_components(df, k=4, percent=85)
    assert sorted((x["doc_id"], x["component_id"]) for x in got.collect()) == sorted(reach.items())
    assert len(set(reach.values())) < 150
