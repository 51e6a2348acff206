"""Repair of conversation structure by the cheapest edits, with a persistent audit.

A conversation's rows, in order, are to read ``(s?(ua)+)?`` by the first
letters of their roles.  Each row is Kept (cost 0), Reroled to user or
assistant (1) or Deleted (2), and rows without text of either role can be
Inserted anywhere (5).  Rows that are blank or repeat an earlier row's role and
text must be deleted; a truncated row that stays adds 5.  Of the cheapest ways
the one whose audit (the edits' initials) is least in ASCII order is taken.

The search keeps, for each state (nothing yet, s, u, a), the cheapest edits
that lead there.  Their audits share beginnings: an audit is a node that links
to the one it prolongs, with the ancestors 1, 2, 4, ... steps back and a
rolling hash of the whole.  Equal costs are settled at the first letter in
which two audits differ, found by going back in those steps while the hashes
differ; the letters of what is taken to be equal are then compared down to a
shared node, so a collision of hashes cannot decide.  What all states share is
settled from time to time and leaves the nodes, so memory holds one byte an
edit of the conversation and the nodes of an open stretch.

A conversation is searched in one task on narrow rows (no text) and its rows
are then edited in one task as a stream, since its audit and its digest are
one value each; texts are never gathered.  Repeats are found by a running count over
(conversation, role, text), dealt out by all three.

Defined results: null roles and texts are one space (so such a text is blank);
rows are ordered by turn (null first), then role, then the SHA-256 of the
text; a null conversation id is a conversation of its own; an empty role can
only be reroled or deleted; repeated rows are duplicates; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, stored

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
FAULTS = ("", "blank", "duplicate", "truncated")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: what the repaired rows end with
BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}

MODULUS, BASE = (1 << 61) - 1, 911382323
SETTLE = 1 << 14  # nodes after which the shared beginning is settled


class Audits:
    """Strings that share their beginnings: nodes with ancestors in steps of powers of two and rolling hashes.

    Node 0 is the empty string (or what is settled, which all others begin with).
    """

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.settled = bytearray()
        self._clear()

    def _clear(self) -> None:
        self.letter, self.depth, self.hash, self.back = [0], [0], [0], [()]

    def __len__(self) -> int:
        return len(self.letter)

    def longer(self, node: int, letter: str) -> int:
        """The string of ``node`` and one letter more."""
        back, k = [node], 0
        while k < len(self.back[back[k]]):
            back.append(self.back[back[k]][k])
            k += 1
        self.letter.append(ord(letter))
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.modulus)
        self.back.append(tuple(back))
        return len(self.letter) - 1

    def _ancestor(self, node: int, depth: int) -> int:
        """The beginning of ``depth`` letters."""
        steps, k = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.back[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def _difference(self, a: int, b: int) -> tuple[int, int] | None:
        """The nodes of the first letter in which two strings of one length differ."""
        if a == b:
            return None
        first = None
        if self.hash[a] != self.hash[b]:  # else nothing differs, unless the hashes collide
            for k in reversed(range(len(self.back[a]))):
                if k < len(self.back[a]) and self.hash[self.back[a][k]] != self.hash[self.back[b][k]]:
                    a, b = self.back[a][k], self.back[b][k]
            first = (a, b)
            a, b = self.back[a][0], self.back[b][0]
        while a != b:  # the beginnings have equal hashes; are they equal?
            if self.letter[a] != self.letter[b]:
                first = (a, b)
            a, b = self.back[a][0], self.back[b][0]
        return first

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        found = self._difference(self._ancestor(a, depth), self._ancestor(b, depth))
        return self.depth[a] < self.depth[b] if found is None else self.letter[found[0]] < self.letter[found[1]]

    def string(self, node: int) -> bytes:
        """The letters of a node after the settled ones."""
        out = bytearray()
        while node:
            out.append(self.letter[node])
            node = self.back[node][0]
        return bytes(out[::-1])

    def settle(self, live: list[int]) -> list[int]:
        """Move the shared beginning of the live nodes to ``settled`` and keep only what they need; their new numbers."""
        root = live[0]
        for node in live[1:]:
            depth = min(self.depth[root], self.depth[node])
            root, node = self._ancestor(root, depth), self._ancestor(node, depth)
            while root != node:
                root, node = self.back[root][0], self.back[node][0]
        keep = set()
        for node in live:
            while node != root and node not in keep:
                keep.add(node)
                node = self.back[node][0]
        old = (self.letter, self.back)
        self.settled += self.string(root)
        self._clear()
        new = {root: 0}
        for node in sorted(keep):  # a node is younger than the one it prolongs
            new[node] = self.longer(new[old[1][node][0]], chr(old[0][node]))
        return [new[n] for n in live]


class Search:
    """The cheapest edits of one conversation, row by row."""

    def __init__(self, settle: int = SETTLE, modulus: int = MODULUS):
        self.audits, self.settle_at = Audits(modulus), settle
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]  # cost and audit of each state

    def _better(self, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
        return old is None or new[0] < old[0] or new[0] == old[0] and self.audits.less(new[1], old[1])

    def _offer(self, best: list, state: int, before: tuple[int, int], letter: str, more: int = 0) -> None:
        cost = before[0] + COST[letter] + more
        if best[state] is None or cost <= best[state][0]:
            new = (cost, self.audits.longer(before[1], letter))
            if self._better(new, best[state]):
                best[state] = new

    def _inserted(self) -> list:
        """``best`` after the insertions that can stand in one place (two at most help)."""
        best = list(self.best)
        for state in (USER, ASSISTANT):
            for b in BEFORE[state]:
                if (best if state == ASSISTANT else self.best)[b] is not None:
                    self._offer(best, state, (best if state == ASSISTANT else self.best)[b], INSERT)
        return best

    def row(self, initial: str, fault: int) -> None:
        open_, best = self._inserted(), [None] * 4
        more = TRUNCATED_COST if FAULTS[fault] == "truncated" else 0
        for state, before in enumerate(open_):
            if before is None:
                continue
            self._offer(best, state, before, DELETE)
            if FAULTS[fault] in ("blank", "duplicate"):
                continue
            for after, allowed in BEFORE.items():
                if state in allowed:
                    if STATE.get(initial) == after:
                        self._offer(best, after, before, KEEP, more)
                    if after in ROLE:
                        self._offer(best, after, before, REROLE, more)
        self.best = best
        if len(self.audits) > self.settle_at:
            states = [s for s in range(4) if best[s] is not None]
            for s, node in zip(states, self.audits.settle([best[s][1] for s in states])):
                self.best[s] = (best[s][0], node)

    def result(self) -> tuple[int, str]:
        """Cost and audit."""
        ends = [e for e in (self._inserted()[s] for s in (NOTHING, ASSISTANT)) if e is not None]
        cost, node = ends[0] if len(ends) == 1 or not self._better(ends[1], ends[0]) else ends[1]
        return cost, (self.audits.settled + self.audits.string(node)).decode()


def clean(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn (long), role, text, sha (of the text), with nulls of roles and texts as one space."""
    rows = turns.select(col(conv_col).alias("conv_id"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"))
    return rows.withColumn("sha", F.sha2("text", 256))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, sha, fault (its number in FAULTS) of the rows of ``clean``; no texts."""
    ended = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "role", "sha", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "sha").orderBy(F.col("turn").asc_nulls_first())) > 1
    # The count runs before the choice, as Spark evaluates it for every row anyway.
    return narrow.withColumn("again", again).select("conv_id", "turn", "role", "sha", F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("truncated"), 3).otherwise(0).alias("fault"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows in one task, in order."""
    keys = ["conv_id", *first, F.col("turn").asc_nulls_first(), "role", "sha"]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of the conversations of ``clean`` rows."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = conv = conv_array = None
        for batch in it:
            conv_array = batch.column(0).type
            out = []
            for own, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if search is None or own != conv:
                    if search is not None:
                        out.append((conv, *_counted(turns, found, illegal), *search.result()))
                    search, conv, turns, found, illegal, last = Search(), own, [None, None, 0], [0] * len(FAULTS), 0, None
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                found[fault] += 1
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                search.row(initial, fault)
            yield _batch(out, conv_array)
        if search is not None:
            yield _batch([(conv, *_counted(turns, found, illegal), *search.result())], conv_array)

    def _counted(turns, found, illegal):
        gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]
        return gaps, *found[1:], illegal

    def _batch(out, conv_array):
        columns = list(zip(*out)) or [()] * (len(counts) + 2)
        return pa.record_batch([pa.array(columns[0], conv_array), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.string())], ["conv_id", *counts, "audit"])

    narrow = _ordered(faults(rows)).select("conv_id", "turn", F.substr("role", F.lit(1), F.lit(1)), "fault")
    return narrow.mapInArrow(run, f"conv_id {conv_type}, " + ", ".join(f"{c} long" for c in counts) + ", audit string")


def edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, edit, role, text: each conversation's rows in order with the edit of each; deleted ones too.

    ``rows`` are those of ``clean``, ``found`` their ``audits``.  The rows of a
    conversation follow each other in one partition.
    """
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "edit", "role", "text"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == INSERT:
                state = ASSISTANT if state == USER else USER
                out.append((conv, INSERT, ROLE[state], ""))
                at += 1

        conv, audit, at, state, out = None, "", 0, NOTHING, []
        for batch in it:
            for own, role, text, new in zip(*(c.to_pylist() for c in batch.columns)):
                if new is not None:  # the audit comes before the rows
                    added()
                    conv, audit, at, state = own, new, 0, NOTHING
                    continue
                added()
                edit = audit[at]
                at += 1
                if edit == KEEP:
                    state = STATE[role[0]]
                elif edit == REROLE:
                    state = ASSISTANT if state == USER else USER
                    role = ROLE[state]
                out.append((own, edit, role, text))
            yield batch_of(out, batch.column(0).type)
            kept, out = batch.column(0).type, []
        added()
        if out:
            yield batch_of(out, kept)

    def batch_of(out, conv_array):
        columns = list(zip(*out)) or [()] * 4
        return pa.record_batch([pa.array(columns[0], conv_array), *(pa.array(c, pa.string()) for c in columns[1:])], names)

    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("sha"), "audit", F.lit(0).alias("kind"))
    both = heads.unionByName(rows.withColumns({"audit": none, "kind": F.lit(1)}))
    return _ordered(both, "kind").select("conv_id", "role", "text", "audit").mapInArrow(run, f"conv_id {conv_type}, edit string, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the rows that ``edited`` keeps, as ``role:text`` joined by line ends."""
    conv_type = edits.schema["conv_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, first, kind = None, None, True, None
        for batch in it:
            out, kind = [], batch.column(0).type
            for own, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or own != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, first = own, hashlib.sha256(), True
                if edit != DELETE:
                    digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    first = False
            yield pa.record_batch([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return edits.mapInArrow(run, f"conv_id {conv_type}, repaired_sha256 string")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The audit of every conversation, and its rows with their edits."""
    rows = clean(turns, conv_col, turn_col, role_col, text_col)
    found = stored(audits(rows), "audits")
    return found, edited(rows, found)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults planted by a checksum of conversation and turn (nulls: one space)."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), what.alias("damage")).filter("damage <> 0")
    own = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), own.alias("text"),
                       F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"))
    return made.drop("copy")


def _oracle() -> str:
    """The query in SQL: one recursion over row numbers with the best (cost, audit, rows) of each state."""
    never = 1_000_000_000

    def first(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def step(x: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {line}}}"

    def inserted(x: str, role: str) -> str:
        return step(x, "5", "I", f"'{role}:' || chr(10)")

    def opened(a: str, which: str) -> str:
        """Columns y0 to y3 after insertions, from the struct columns x0 to x3 of ``a``."""
        y2 = first(f"{a}.x2", *(inserted(f"{a}.x{i}", "user") for i in (0, 1, 3)))
        return f"SELECT *, {first(f'{which}.x3', inserted('y2', 'assistant'))} AS y3 FROM (SELECT *, x0 AS y0, x1 AS y1, {y2} AS y2 FROM {a}) {which}"

    def kept(x: str, initial: str) -> str:
        return step(x, f"CASE WHEN fault IN (1, 2) OR initial <> '{initial}' THEN {never} WHEN fault = 3 THEN 5 ELSE 0 END", "K", "role || ':' || body || chr(10)")

    def reroled(x: str, role: str) -> str:
        return step(x, f"CASE WHEN fault IN (1, 2) THEN {never} WHEN fault = 3 THEN 6 ELSE 1 END", "R", f"'{role}:' || body || chr(10)")

    def deleted(x: str) -> str:
        return step(x, "2", "D")

    z = [deleted("y0"), first(deleted("y1"), kept("y0", "s")),
         first(deleted("y2"), *(f(x, n) for x in ("y0", "y1", "y3") for f, n in ((kept, "u"), (reroled, "user")))),
         first(deleted("y3"), kept("y2", "a"), reroled("y2", "assistant"))]
    nothing = "{'c': %d, 'a': '', 't': ''}"
    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS body, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(key, '')]),
    lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 20 AS damage FROM given
), hurt AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body,
    unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE damage <> 0
), numbered AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(body)) AS n FROM hurt
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(body, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY n) > 1 THEN 2
    WHEN regexp_extract(body, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS two FROM numbered
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, {nothing % 0} AS x0, {nothing % never} AS x1, {nothing % never} AS x2, {nothing % never} AS x3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT o.conv_id, r.n, {z[0]}, {z[1]}, {z[2]}, {z[3]} FROM ({opened('walk', 'w')}) o JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.n = o.n + 1
), last AS (
  SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), done AS (SELECT conv_id, {first('y0', 'y3')} AS b FROM ({opened('last', 'l')})),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(CASE WHEN b.t = '' THEN '' ELSE left(b.t, length(b.t) - 1) END) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""


ORACLE = _oracle()
