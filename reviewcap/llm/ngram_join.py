"""Similarity self-join of documents on word shingles, with adaptive multi-match prefixes.

A document's set holds its distinct shingles.  All sets are put in one order,
rare shingles first: the frequent ones, by counts of documents from mergeable
summaries (``FREQUENT`` shingles at any size, used for the order only), come last.  Two sets whose similarity reaches the threshold share
at least l shingles within their prefixes of length |x| - need + l, for every
l.  Each document chooses its own l: the estimated number of partners that
its prefix brings falls as more shared shingles are asked for, while the
prefix, and with it what is read, grows.  A pair is asked for the smaller l of
the two, counted within the prefixes that belong to it, and only pairs with
that many are verified on the whole sets.  Shingles that occur in the prefixes of
one component only cannot bring a pair and are left out before the join.  Each
class carries a parity sketch: every bit that differs between two sketches stands
for a shingle that only one of the sets has, so pairs whose sketches differ in
more bits than the threshold allows are not formed.

Documents with the same set are one class, which is joined once; a task sends
each class's prefix once, however many copies it holds.  The whole sets are
sent only for classes that are in a candidate pair.  ``ngram_join`` finds every
link; its work grows with the links, so with the square of a group of near
copies.  ``ngram_components`` and ``without_near_duplicates`` need components
only and do not look for links within a component that they know already.

Defined results: a document without words (or with null text) has no shingle
and links with nothing; one with fewer words than a shingle has one, the
whole sequence; a null id is not linked and has no component; rows that
repeat an id and a text are copies of each other; an empty table gives no
row; of an id with several texts each row has its own text's result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import batches, release
from .common import col, one_of_repeated, stored
from .components import components

FREQUENT = 1 << 20  # shingles that a summary keeps
UNSEEN = 1.0  # partners that a shingle in no summary is taken to bring
GATHERED = 1 << 20  # shingles that are counted at once
MARKS = 1 << 22  # of the bitmap of classes that are in a candidate pair
ORDERS = 8  # smallest hashes kept of a set
AGREED = 3  # of these that two sets share before they are compared on the way to known components
NEXT = 8  # classes that each is compared with under each order, of those with the same smallest hash
BLOCK = 1 << 10  # classes with the same smallest hash that are dealt together
SKETCH = 8  # words of 64 bits in a set's parity sketch
GROUPED = 1 << 20  # shingles of whole sets that a task sends at once
MOST_SHARED = 8  # the largest l that is tried
VERIFY = 32.0  # cost of a verification, in shingles read
MINS = [f"m{j}" for j in range(ORDERS)]
SKETCHES = [f"s{j}" for j in range(SKETCH)]
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles."""
    words = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
    n = [len(w) for w in words]
    flat = np.empty(sum(n), object)
    flat[:] = list(chain.from_iterable(words))
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(hashed) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = _mix(rolled + hashed[i:len(hashed) - k + 1 + i] + np.uint64(i + 1)) if len(rolled) else rolled
    out, at = [], 0
    for m in n:
        if m >= k:
            out.append(np.unique(rolled[at:at + m - k + 1]))
        elif m:
            one = np.zeros(1, np.uint64)
            for i in range(m):
                one = _mix(one + hashed[at + i:at + i + 1] + np.uint64(101 + i))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def parity_sketch(own: np.ndarray) -> list[int]:
    """Bits that say whether an odd number of the set's shingles falls on them, as SKETCH signed words."""
    odd = np.bincount((_mix(own + np.uint64(ORDERS)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    release()
    ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
    for s in batches(texts):
        yield from zip(ids[s], shingle_sets(texts[s], k))


def need(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set that reaches the threshold."""
    return -(-size * percent // 100)


class Frequent:
    """A mergeable summary of how many documents have a shingle: counts of ``most`` shingles, too low by an equal share at most."""

    def __init__(self, most: int = FREQUENT):
        self.most, self.keys, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, own: np.ndarray) -> None:
        self.waiting.append(own)
        self.size += len(own)
        if self.size >= GATHERED:
            self.merge()

    def merge(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([self.counts, n]), len(keys)).astype(np.int64)
        if len(keys) > self.most:
            counts -= np.partition(counts, len(counts) - self.most - 1)[len(counts) - self.most - 1]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]


def prefix_of(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set's prefix, rare ones first, and the number l it was chosen for."""
    keys, counts = frequent
    often = np.full(len(own), UNSEEN)
    if len(keys):
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        often = np.where(keys[place] == own, counts[place] + UNSEEN, UNSEEN)
    order = np.lexsort((own, often))
    base = len(own) - need(len(own), percent)
    most = min(MOST_SHARED, len(own) - base)
    partners = np.cumsum(often[order[:base + most]])
    shared = np.arange(1, most + 1)
    reads = partners[base:base + most]
    best = int(np.argmin(reads + base + shared + VERIFY * reads / shared)) + 1
    return own[order[:base + best]], best


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds, from (doc_id, text, tie): doc_id, n, k1, k2 (size and key of the set), m0 to m7
    (its smallest hashes under eight orders), s0 to s7 (its sketch), tie; and shingle, count (frequent ones of a task)."""
    names = ["doc_id", "n", "k1", "k2", *MINS, *SKETCHES, "tie", "shingle", "count"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent()
        for batch in it:
            rows = []
            for doc, own in _sets(batch, k):
                low = [int(_mix(own + np.uint64(j)).min().astype(np.int64)) for j in range(ORDERS)] if len(own) else [None] * ORDERS
                rows.append((doc, len(own), *set_key(own), *low, *parity_sketch(own)))
                seen.add(own)
            columns = list(zip(*rows)) or [()] * (4 + ORDERS + SKETCH)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), batch.column(2), none, none], names)
        seen.merge()
        often = seen.counts > 1
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.record_batch([*[none] * (5 + ORDERS + SKETCH), pa.array(seen.keys[often].view(np.int64)), pa.array(seen.counts[often])], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def classified(docs: DataFrame, k: int, unnamed: bool = False) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Documents (doc_id, n, k1, k2, tie: hash of the text), classes (k1, k2, node, least, members, n, m0 to m7, s0 to s7)
    and frequent shingles with counts.

    Rows with a null id are in no class, unless ``unnamed``.
    """
    made = stored(describe(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")), k), "sets")
    described = made.filter("shingle IS NULL")
    often = made.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()  # FREQUENT rows at most
    keys = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    counts = (keys[order], often["n"].to_numpy(np.int64)[order])
    same = [F.min(c).alias(c) for c in ("n", *MINS, *SKETCHES)]  # of equal sets
    classes = described.filter("n > 0" if unnamed else "n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"), *same)
    # The number of a class is drawn when it is stored; later stages read it.
    return described.select("doc_id", "n", "k1", "k2", "tie"), stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes"), counts


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs a, b (numbers of classes) whose whole sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(ends.join(classes.select("node", "k1", "k2"), "node"), "wanted-sets")
    # Only sets that may be in a pair are sent: a bitmap of their keys, of MARKS bits at any size, says which.
    marks = np.zeros(MARKS, bool)
    marks[[r["m"] for r in wanted.select(F.col("k1").bitwiseAND(F.lit(MARKS - 1)).alias("m")).distinct().collect()]] = True  # MARKS rows at most

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()

        def sent(keys: list[tuple[int, int]], sets: list[np.ndarray]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            return pa.record_batch([pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()), pa.ListArray.from_arrays(ends, values)], ["k1", "k2", "own"])

        for batch in it:
            keys, sets, held = [], [], 0
            for _, own in _sets(batch, k):
                key = set_key(own)
                if marks[key[0] & (MARKS - 1)] and key not in done:
                    done.add(key)
                    keys.append(key)
                    sets.append(own)
                    held += len(own)
                    if held >= GROUPED:
                        yield sent(keys, sets)
                        keys, sets, held = [], [], 0
            yield sent(keys, sets)

    # Several tasks may send a set; the join takes over how the rows of one set were brought together.
    sets = docs.mapInArrow(whole, "k1 long, k2 long, own array<long>").dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("node", "own")
    sets = stored(sets, "candidate-sets")
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    reached = (100 + percent) * F.size(F.array_intersect("x", "y")).cast("long") >= percent * (F.size("x").cast("long") + F.size("y"))
    return stored(pairs.join(left, "a").join(right, "b").filter(reached).select("a", "b"), "links")


def least_overlap(x: str, y: str, percent: int) -> Column:
    """The shingles that sets of ``x``.n and ``y``.n shingles share at least when they reach the threshold."""
    return F.expr(f"({percent}L * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}")


def sketches_allow(x: str, y: str, percent: int) -> Column:
    """Whether the sketches of ``x`` and ``y`` differ in no more bits than sets that reach the threshold can."""
    differ = F.expr(" + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in SKETCHES))
    return differ <= F.expr(f"{x}.n + {y}.n") - 2 * least_overlap(x, y, percent)


def near_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with the NEXT ones of a random row of those with its smallest hash, where AGREED hashes and the sketches allow a link.

    These are at most ORDERS * NEXT pairs a class, however large its group of
    near copies is.  Each order deals the group anew, so that links between some
    random pairs a class bring nearly all of it together even where only one pair of
    ten reaches the threshold: of 64 pairs a class, some six link.  What they leave
    apart the prefix join finds, whose rows are as many as are left apart times the group.
    """
    each = classes.select("node", F.posexplode(F.array(*MINS)).alias("j", "m")).withColumn("digest", F.xxhash64("j", "m"))
    members = each.groupBy("digest", "j", "m").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Both sides are dealt out anew for the join on the hash, so that Spark can split a large group's rows.
    turned = each.join(members, ["digest", "j", "m"]).withColumn("turn", F.xxhash64("node", "j"))
    turned = turned.withColumn("block", F.expr(f"pmod(turn, (members + {BLOCK - 1}) div {BLOCK})"))
    row = Window.partitionBy("digest", "j", "m", "block").orderBy("turn", "node")
    following = F.array(*[F.lead("node", i).over(row) for i in range(1, NEXT + 1)])
    pairs = turned.select("node", following.alias("following")).select("node", F.explode("following").alias("other")).filter("other IS NOT NULL")
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    known = classes.select("node", "n", *MINS, *SKETCHES)
    agreed = F.expr(" + ".join(f"CAST(x.{c} = y.{c} AS INT)" for c in MINS)) >= AGREED
    both = pairs.join(known.alias("x"), F.col("a") == F.col("x.node")).join(known.alias("y"), F.col("b") == F.col("y.node"))
    return both.filter(agreed & sketches_allow("x", "y", percent)).select("a", "b")


def prefix_pairs(docs: DataFrame, labelled: DataFrame, counts: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """a, b: pairs of classes of different components (``labelled``: k1, k2, node, s0 to s7, component, size: its classes) that share enough of their prefixes."""
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in it:
            keys, sizes, chosen, prefixes = [], [], [], []
            for _, own in _sets(batch, k):
                key = set_key(own)
                if len(own) and key not in done:
                    done.add(key)
                    prefix, shared = prefix_of(own, counts, percent)
                    keys.append(key)
                    sizes.append(len(own))
                    chosen.append(shared)
                    prefixes.append(prefix.astype(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.record_batch([pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()), pa.array(sizes, pa.int32()), pa.array(chosen, pa.int32()), values],
                                  ["k1", "k2", "n", "l", "prefix"])

    sent = docs.mapInArrow(send, "k1 long, k2 long, n int, l int, prefix array<long>")
    # Several tasks may send a class; the join takes over how the rows of one class were brought together.
    own = sent.dropDuplicates(["k1", "k2"]).join(labelled.select("k1", "k2", "node", "component", "size"), ["k1", "k2"])
    # Narrow rows are dealt out: most shingles lie in one prefix only, and most components are one class (null).
    packed = F.expr("shiftleft(CAST(pos AS BIGINT), 32) + n * 16L + l").alias("packed")
    own = own.select("node", "n", "l", F.expr("nullif(component, node)").alias("other"), F.expr("nullif(size, 1L)").alias("size"), F.posexplode("prefix").alias("pos", "shingle")).select(
        "node", "other", "size", packed, "shingle")
    within = Window.partitionBy("shingle")
    own = own.withColumn("component", F.coalesce("other", "node"))
    largest = F.max(F.struct(F.coalesce("size", F.lit(1)), "component")).over(within)["component"]
    spread = own.select("*", F.min("component").over(within).alias("lowest"), F.max("component").over(within).alias("highest"), largest.alias("largest")).filter("lowest <> highest")
    spread = spread.selectExpr("node", "component", "component = largest AS main", "shingle", "CAST(shiftright(packed, 32) AS INT) AS pos", "CAST((packed & 4294967295) DIV 16 AS INT) AS n", "CAST(packed & 15 AS INT) AS l")
    postings = stored(spread.join(labelled.select("node", *SKETCHES), "node"), "postings")
    # Both sides are dealt out for this join, so that Spark can split a frequent shingle's rows.  Of a
    # shingle's largest component no two postings meet: one side holds those of the other components only.
    x, y = postings.filter("NOT main").alias("x"), postings.alias("y")
    overlap = least_overlap("x", "y", percent)
    asked = F.least("x.l", "y.l")
    both = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & F.expr("x.component <> y.component AND (y.main OR x.node < y.node)")
                  & F.expr(f"100L * x.n >= {percent} * y.n AND 100L * y.n >= {percent} * x.n")
                  & (F.col("x.pos") < F.col("x.n") - overlap + asked) & (F.col("y.pos") < F.col("y.n") - overlap + asked)
                  & sketches_allow("x", "y", percent))
    return both.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(
        F.count(F.lit(1)).alias("found"), F.min(asked).alias("asked")).filter("found >= asked").select("a", "b")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with the smallest id of the component that the links a, b make, as ``component``."""
    reached = components(links).withColumnRenamed("v", "node").withColumnRenamed("component", "root")
    rooted = stored(classes.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # Joining on the digest too deals out both sides anew, so that Spark can split a large component's rows.
    return rooted.withColumn("digest", F.xxhash64("root")).join(lowest.withColumn("digest", F.xxhash64("root")), ["digest", "root"]).drop("digest")


def _labels(described: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """doc_id, n, component (its own id without a class), k1, k2 and the columns ``more`` of ``known`` for every row."""
    # Spark can split a large class's rows, as both sides are dealt out for this join.
    joined = described.join(known.select("k1", "k2", "component", *more), ["k1", "k2"], "left")
    single = (F.col("n") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", "n", F.when(single, F.col("doc_id")).otherwise(F.col("component")).alias("component"), "k1", "k2", *[F.when(~single, F.col(c)).alias(c) for c in more])


def class_links(rows: DataFrame, classes: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """a, b: every pair of classes whose sets reach the threshold, once."""
    each = classes.select("k1", "k2", "node", *SKETCHES, F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    return verified(rows, classes, stored(prefix_pairs(rows, each, counts, k, percent), "candidate-pairs"), k, percent)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row.

    Two documents link when 100 * |shared| >= percent * |all|; ``component_id``
    is the smallest id that a document reaches by links (its own at least), and
    ``n_links`` counts the other rows that it links with.
    """
    rows = _rows(docs, id_col, text_col)
    described, classes, counts = classified(rows, k)
    links = class_links(rows, classes, counts, k, percent)
    known = _named(classes, links)
    size = classes.select("node", "members")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size, both["b"] == size["node"]).groupBy("a").agg(F.sum("members").alias("others"))
    known = known.join(others.withColumnRenamed("a", "node"), "node", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("members") - 1)
    return _labels(described, known, "n_links").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def known_components(rows: DataFrame, k: int, percent: int, unnamed: bool) -> tuple[DataFrame, DataFrame]:
    """The described rows (doc_id, text), and the classes with the components of ``ngram_join``.

    Pairs within a component that is already known are not formed: first each
    class is held against a few of those with the same smallest hash, which
    brings groups of near copies together; the prefix join then looks for all
    links between different components.
    """
    described, classes, counts = classified(rows, k, unnamed)
    near = verified(rows, classes, stored(near_pairs(classes, percent), "near-pairs"), k, percent)
    reached = components(near).select(F.col("v").alias("node"), "component")
    # Components of several classes only have a size to look up.
    sizes = reached.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    reached = reached.withColumn("digest", F.xxhash64("component")).join(sizes.withColumn("digest", F.xxhash64("component")), ["digest", "component"]).drop("digest")
    labelled = classes.select("k1", "k2", "node", *SKETCHES).join(reached, "node", "left")
    labelled = stored(labelled.withColumn("component", F.coalesce("component", "node")).withColumn("size", F.coalesce("size", F.lit(1))), "labels")
    rest = verified(rows, classes, stored(prefix_pairs(rows, labelled, counts, k, percent), "candidate-pairs"), k, percent)
    return described, _named(classes, near.unionByName(rest))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, as ``ngram_join`` gives them, without its number of links."""
    described, known = known_components(_rows(docs, id_col, text_col), k, percent, unnamed=False)
    return _labels(described, known).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def near_components(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tie, component (smallest id, null where all are), root (its number) of every row (doc_id, text) with a word.

    Components are those of ``ngram_join``, in which rows with a null id take part too.
    """
    described, known = known_components(rows, k, percent, unnamed=True)
    # Spark can split a large class's rows, as both sides are dealt out for this join.
    return described.join(known.select("k1", "k2", "component", "root"), ["k1", "k2"]).select("doc_id", "tie", "component", "root")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Exactly one row of each component, with all its columns, and every row without words.

    It is one with the smallest id (null only where all ids are); of several texts of that id, the one with the smallest hash.
    """
    found = stored(near_components(_rows(docs, id_col, text_col), k, percent), "near-components")
    first = F.col("doc_id").eqNullSafe(F.col("component"))
    several = found.filter(first).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("tie").alias("best"), F.max("tie").alias("worst")).filter("n > 1")
    several = stored(several, "repeated-ids")
    lost = found.filter(~first).select("doc_id", "tie")
    other = found.filter(first).join(several.filter("best <> worst"), "root").filter("tie <> best").select("doc_id", "tie")
    lost = lost.unionByName(other).distinct().toDF("_lost_id", "_lost_tie")
    key, tie = col(id_col).cast("long"), F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))
    kept = docs.join(lost, key.eqNullSafe(F.col("_lost_id")) & (tie == F.col("_lost_tie")), "left_anti")
    again = found.filter(first).join(several, "root").filter("tie = best").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return one_of_repeated(kept, key, tie, again.select("doc_id", "tie"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(list_slice(words, i, i + 3), ' ') for i in range(1, len(words) - 2)] END) AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = s.doc_id) AS component_id
FROM s
"""

# ORACLE with the number of links of each document.
LINKS_ORACLE = ORACLE.replace("AS component_id\n", "AS component_id,\n  (SELECT count(*) FROM links WHERE links.a = s.doc_id) AS n_links\n")
