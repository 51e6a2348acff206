"""Interaction of document filters in every order, with copies found by radix text tries.

Five filters look at whole texts; each document gets a mask of the filters it
fails.  Four of them need the text alone.  The fifth (E: the text equals that
of a smaller id) is found by tries:

1. a task merges the texts of a window of rows (bounded in bytes and rows) in
   a compressed trie whose terminals hold the smallest id, so copies leave a
   task once a window, and a row keeps only the number of its terminal;
2. the windows' texts are dealt out by ranges of prefixes, each as long as it
   takes to tell two neighbouring cut texts apart, and sorted in their range;
3. the full texts of a range go into a trie again.  When it holds enough it
   is traversed, which gives the smallest id of every text met more than
   once, and only the last text's terminal is kept, as later texts are not
   smaller.  A row fails E when its id is larger than its terminal's.

The masks are then counted by part (32 of them at most) and everything
asked about all 120 orders follows from these counts.  The cut texts come from
a bounded sample, which decides how even the ranges are and nothing else.

Defined results: a null text counts as empty; a null id is no smaller id and
fails no E and has no labels; rows that repeat an id and a text do not fail E by each other; a
null part is the empty one; a document is good (toxic) when any label row of
its id says so; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored

FILTERS = "ABCDE"
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
LATER_BYTES = bytes(range(0x80, 0xC0))  # of a character, after its first
WINDOW_BYTES, WINDOW_ROWS = 16 << 20, 1 << 16  # what a trie holds at most (but for one text more)
RANGE_BYTES = 32 << 20  # of the texts of a range, where the sample allows
SAMPLE_TEXTS = 1 << 14  # from which prefixes are cut; a range has eight of them at least


class TextTrie:
    """A compressed trie of byte strings: a terminal holds the smallest id and its members.

    A node is [label, children by first byte, number of its terminal or None].
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.least: list[int | None] = []
        self.members: list[array] = []
        self.rows: list[int] = []

    def insert(self, text: bytes, doc_id: int | None, rows: int = 1) -> int:
        """The terminal of ``text``, which now stands for ``rows`` rows more."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
            elif not text.startswith(child[0], at):
                child = self._split(node, child, len(commonprefix([child[0], text[at:at + len(child[0])]])))
            node, at = child, at + len(child[0])
        if node[2] is None:
            node[2] = len(self.least)
            self.least.append(doc_id)
            self.members.append(array("q"))
            self.rows.append(rows)
            return node[2]
        n = node[2]
        self.rows[n] += rows
        if doc_id is not None and (self.least[n] is None or doc_id < self.least[n]):
            self.least[n] = doc_id
        return n

    @staticmethod
    def _split(parent: list, child: list, shared: int) -> list:
        """A new node for the first ``shared`` bytes of the child's label."""
        upper = parent[1][child[0][0]] = [child[0][:shared], {child[0][shared]: child}, None]
        child[0] = child[0][shared:]
        return upper

    def terminals(self) -> Iterator[int]:
        """The numbers of all terminals, met by traversing the trie."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())


def text_mask(raw: bytes) -> int:
    """The bits of A to D that a UTF-8 text fails: short, repetitive, capitals, marks."""
    n_chars = len(raw.translate(None, LATER_BYTES))
    words = raw.split()  # bytes are split at \x20 and \x09 to \x0D only
    capitals = len(raw) - len(raw.translate(None, UPPER))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * n_chars, len(raw.translate(None, MARKS)) < len(raw))
    return sum(1 << i for i, f in enumerate(fails) if f)


def prefix_cuts(texts: DataFrame, sample_texts: int = SAMPLE_TEXTS, range_bytes: int = RANGE_BYTES) -> list[bytes]:
    """Sorted prefixes that cut the column ``text`` (binary) into ranges, an eighth of the sample's texts at most."""
    every = max(1, texts.count() // sample_texts)
    # Drawn by a hash of the text, so that copies are drawn together and count once.
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, before, size, n, cuts = max(1, range_bytes // every), None, 0, 0, []
        for batch in it:
            for text in batch.column(0).to_pylist():
                if size >= share and n >= 8:
                    cuts.append(text[:len(commonprefix([before, text])) + 1])
                    size = n = 0
                before, size, n = text, size + len(text), n + 1
        yield pa.record_batch([pa.array(cuts, pa.binary())], ["cut"])

    found = sample.repartition(1).sortWithinPartitions("text").mapInArrow(cut, "cut binary")
    return sorted(r["cut"] for r in found.collect())  # sample_texts / 8 rows at most


def windows(docs: DataFrame, cuts: list[bytes], most_bytes: int = WINDOW_BYTES, most_rows: int = WINDOW_ROWS) -> DataFrame:
    """From (doc_id, part, text): a row (doc_id, part, mask, terminal) of each document, and a row
    (terminal, range, text, least, n) of each distinct text of a window."""
    names = ["doc_id", "part", "mask", "terminal", "range", "text", "least", "n"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            lo = size = 0
            for hi, text in enumerate(texts, 1):
                size += len(text)
                if hi == len(texts) or size > most_bytes // 4:
                    own, m = texts[lo:hi], hi - lo
                    yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.array(range(base + lo, base + hi), pa.int64()),
                                           pa.array([bisect_right(cuts, t) for t in own], pa.int32()), pa.array(own, pa.binary()), pa.array(trie.least[lo:hi], pa.int64()),
                                           pa.array(trie.rows[lo:hi], pa.int64())], names)
                    lo, size = hi, 0

        trie, texts, masks, size, seen, base = TextTrie(), [], [], 0, 0, None
        for batch in it:
            if base is None and batch.num_rows:
                base = batch.column(3)[0].as_py()  # a task's terminals are no more than its rows, and take their numbers
            own, terminals, m = [], [], batch.num_rows
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(2)):
                if size > most_bytes or seen >= most_rows:
                    yield from found()
                    base += len(texts)
                    trie, texts, masks, size, seen = TextTrie(), [], [], 0, 0
                raw = value.as_py() or b""
                n = trie.insert(raw, doc_id)
                if n == len(masks):
                    masks.append(text_mask(raw))
                    texts.append(raw)
                    size += len(raw)
                seen += 1
                own.append(masks[n])
                terminals.append(base + n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(terminals, pa.int64()), pa.nulls(m, pa.int32()),
                                   pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
        yield from found()

    rows = docs.select("doc_id", "part", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, terminal long, range int, text binary, least long, n long")


def smallest_ids(texts: DataFrame, ranges: int, most_bytes: int = WINDOW_BYTES) -> DataFrame:
    """terminal, first_id of each window text (terminal, range, text, least, n) that more than one row has."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            ids, firsts = array("q"), []
            for n in trie.terminals():
                if trie.rows[n] > 1:
                    ids.extend(trie.members[n])
                    firsts.extend([trie.least[n]] * len(trie.members[n]))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(firsts, pa.int64())], ["terminal", "first_id"])

        trie, last, size = TextTrie(), None, 0
        for batch in it:
            for terminal, value, least, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = value.as_py()
                if size > most_bytes:
                    kept = trie.insert(last, None, 0)
                    first, before = trie.least[kept], trie.rows[kept]
                    held = trie.members[kept] if before == 1 else array("q")  # whether it has copies is not known yet
                    yield found()
                    trie, size = TextTrie(), 0
                    trie.members[trie.insert(last, first, before)].extend(held)
                n = trie.insert(text, least, rows)
                trie.members[n].append(terminal)
                size, last = size + 8 + (len(text) if text != last else 0), text
        yield found()

    dealt = texts.select("terminal", "text", "least", "n", "range").repartitionById(ranges, "range")
    # Of equal texts the smallest id comes first, so what was found of a text stands.
    return dealt.sortWithinPartitions("text", F.col("least").asc_nulls_last()).drop("range").mapInArrow(run, "terminal long, first_id long")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", window_bytes: int = WINDOW_BYTES,
                  window_rows: int = WINDOW_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i of FILTERS) of every row; the limits change no result."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.encode(F.coalesce(col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))
    cuts = prefix_cuts(rows.select("text"), range_bytes=range_bytes)
    made = stored(windows(rows, cuts, window_bytes, window_rows), "windows")
    firsts = smallest_ids(made.filter("text IS NOT NULL"), len(cuts) + 1, window_bytes)
    # A terminal stands for the rows of a window at most, so no key of this join is hot.
    named = made.filter("mask IS NOT NULL").select("doc_id", "part", "mask", "terminal").join(firsts, "terminal", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return named.select("doc_id", "part", (F.col("mask") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled good and toxic."""
    said = labels.groupBy(col(label_id).cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    each = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # a repeated (or null) id is one row

    def total(c: str) -> Column:
        return F.sum(F.col("n") * F.coalesce(c, F.lit(0))).cast("long").alias(c)

    return each.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """Every order of the filters and step in it, for each part of ``mask_counts``."""
    n = len(FILTERS)
    orders = ["".join(p) for p in permutations(FILTERS)]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2 ** n at most
    each = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def bit(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << j) for j in range(n)]), F.ascii(F.substr("filter_order", i, F.lit(1))) - F.lit(ord(FILTERS[0]) - 1))

    earlier = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(n)), F.lit(1), F.col("step") - 1), F.lit(0), lambda a, i: a.bitwiseOR(bit(i)))
    each = each.withColumns({"own": bit(F.col("step")), "earlier": earlier})

    def total(which, value=lambda m: m["n"]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(which(m["mask"]), value(m)).otherwise(F.lit(0).cast("long")))

    own, before = F.col("own"), F.col("earlier")

    def fails(m: Column) -> Column:
        return m.bitwiseAND(own) != 0

    def gone(m: Column) -> Column:
        return m.bitwiseAND(before) != 0

    def here(m: Column) -> Column:
        return fails(m) & ~gone(m)

    # Of all orders, a document's filter is the first of the k that it fails in one of k.
    by_size = F.array(*[F.lit(len(orders) // k).cast("long") for k in range(1, n + 1)])
    return each.select("part", "filter_order", F.col("step").cast("int").alias("step"), total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), total(here).alias("removed"),
                       total(lambda m: fails(m) & gone(m)).alias("redundant"), total(lambda m: m == own).alias("unique_fails"), total(here, lambda m: m["good"]).alias("good_lost"),
                       total(here, lambda m: m["toxic"]).alias("toxic_lost"), total(fails, lambda m: m["n"] * F.element_at(by_size, F.bit_count(m["mask"]))).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of FILTERS over ``docs``, with the columns quality and toxic of ``labels``."""
    return interactions(mask_counts(failure_masks(docs, id_col, text_col, part_col), labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS body FROM documents),
first_ids AS (SELECT body, min(doc_id) AS first_id FROM d GROUP BY body),
w AS (SELECT d.doc_id, part, body, first_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM d JOIN first_ids USING (body)),
f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body),
    regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM w
),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN said USING (doc_id) GROUP BY part, fails
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders),
p AS (
  SELECT part, filter_order, step, n, good, toxic, fails[ascii(substr(filter_order, step, 1)) - 64] AS own,
    len([1 for i in range(1, step) if fails[ascii(substr(filter_order, i, 1)) - 64]]) > 0 AS gone, len([1 for x in fails if x]) AS k,
    substr(filter_order, step, 1) AS letter
  FROM g, steps
),
shares AS (SELECT part, letter, CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS total FROM p GROUP BY part, letter)
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN own AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  any_value(total) AS shapley
FROM p JOIN shares USING (part, letter) GROUP BY part, filter_order, step
"""
