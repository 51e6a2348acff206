"""Packing documents into full sequences: minimum bin slack over remaining lengths.

Each document's ids are cut into pieces of the window's length and a shorter
rest.  Only the number of rests of each length (one number for each length up
to the window) goes to the driver, where every window takes the longest rest
and the multiset of remaining lengths that comes closest to its capacity: a
subset-sum dynamic programme over bitsets, traced back to counts.  A choice
is applied as often as the counts allow.  Where it leaves room, a longer rest
is cut to fill it, and what is left of that rest goes back to the stock; when
fewer ids are left than a window has, the window is the largest power of two
that they fill.  So every sequence is full.

The plan speaks of "the q-th rest of length l"; Spark numbers the rests and
joins them to the plan, so no document passes through the driver.

Defined results: a null or empty text is the end id alone; rows that repeat a
document id or a text are packed on their own; null document ids are packed
like others; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import ID_BYTES, encoded_batches
from .common import col, stored

PLAN_SCHEMA = "length int, q_from long, q_to long, cut int, take int, first_sequence long, offset int, copies int, drawn long"


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """Counts of lengths, none above those given, whose sum is the largest that is not above ``target``.

    Bit s of the set says that s can be reached.  Lengths are tried from the
    longest, each in doubling numbers of copies, until the target is reached.
    """
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted((n for n, k in counts.items() if k and n <= target), reverse=True):
        left, copies = min(counts[length], target // length), 1
        while left and not reach >> target & 1:
            k = min(copies, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, copies = left - k, copies * 2
        if reach >> target & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= length * k
    return chosen


def plan_windows(counts: dict[int, int], window: int) -> list[tuple]:
    """Where every rest goes, as rows of ``PLAN_SCHEMA``.

    A row sends the rests q_from <= q < q_to of ``length``, from their id
    ``cut`` on and ``take`` ids long, to sequences from ``first_sequence``,
    ``copies`` of them to a sequence, the first at ``offset``.
    """
    runs = {n: [(n, 0, k, 0)] for n, k in counts.items() if k}  # remaining length: (length, from, to, cut)
    stock = {n: k for n, k in counts.items() if k}
    total, sequence, rows = sum(n * k for n, k in stock.items()), 0, []

    def draw(remaining: int, number: int) -> list[tuple]:
        out, own = [], runs[remaining]
        stock[remaining] -= number
        while number:
            length, a, b, cut = own.pop()
            k = min(number, b - a)
            out.append((length, a, a + k, cut))
            if a + k < b:
                own.append((length, a + k, b, cut))
            number -= k
        if not stock[remaining]:
            del stock[remaining], runs[remaining]
        return out

    def place(remaining: int, take: int, copies: int, times: int, offset: int) -> None:
        drawn = 0
        for length, a, b, cut in draw(remaining, copies * times):
            rows.append((length, a, b, cut, take, sequence, offset, copies, drawn))
            drawn += b - a
            if take < remaining:
                runs.setdefault(remaining - take, []).append((length, a, b, cut + take))
                stock[remaining - take] = stock.get(remaining - take, 0) + b - a

    while total:
        room = window if total >= window else 1 << (total.bit_length() - 1)
        seed = max((n for n in stock if n <= room), default=0)
        chosen = {seed: 1} if seed else {}
        rest = dict(stock)
        if seed:
            rest[seed] -= 1
            for n, k in fill(rest, room - seed).items():
                chosen[n] = chosen.get(n, 0) + k
        slack = room - sum(n * k for n, k in chosen.items())
        times = min([total // room, *(stock[n] // k for n, k in chosen.items())])
        longer = 0
        if slack:
            longer = max(n for n in stock if n > slack and stock[n] > chosen.get(n, 0))
            times = max(1, min(times, stock[longer] // (chosen.get(longer, 0) + 1)))
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            place(n, n, k, times, offset)
            offset += n * k
        if slack:
            place(longer, slack, 1, times, offset)
        sequence, total = sequence + times, total - room * times
    return rows


def cut_pieces(it: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids) to their pieces: full windows and a rest of each document.

    ``nth`` numbers the pieces of one length within the task that cuts them.
    """
    wide = window * ID_BYTES
    seen: dict[int, int] = {}
    task = TaskContext.get().partitionId()
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for batch in it:
        rows = []
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at in range(0, len(ids), wide):
                piece = ids[at:at + wide]
                n = len(piece) // ID_BYTES
                seen[n] = seen.get(n, -1) + 1
                rows.append((task, doc, at // ID_BYTES, n, len(ids) // ID_BYTES, seen[n], piece))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["task", "doc_id", "start", "length", "doc_tokens", "nth", "ids"])


def pack(docs: DataFrame, path: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary u32) of every piece.

    ``path``: the vocabulary file; ``end_id`` follows each document's ids.
    The pieces are stored once, in the shared folder.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(lambda it: cut_pieces(encoded_batches(it, path, end_id), window),
                             "task int, doc_id long, start long, length int, doc_tokens long, nth long, ids binary")
    pieces = stored(pieces, "pieces")
    by_task = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    by_task = stored(by_task, "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    plan = spark.createDataFrame(plan_windows(counts, window) or [], PLAN_SCHEMA)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = pieces.join(offsets, ["length", "task"]).withColumn("_q", F.col("_before") + F.col("nth"))
    # The plan has a few rows for each length; it is broadcast, as its size follows the window, not the data.
    plan = F.broadcast(plan.withColumnRenamed("length", "_length").withColumnRenamed("offset", "_offset"))
    at = (F.col("drawn") + F.col("_q") - F.col("q_from"))
    return numbered.join(plan, (F.col("length") == F.col("_length")) & (F.col("_q") >= F.col("q_from")) & (F.col("_q") < F.col("q_to"))).select(
        "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("take").cast("long").alias("length"), "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("copies") * F.col("take")).cast("long").alias("offset"),
        F.expr(f"substring(ids, cut * {ID_BYTES} + 1, take * {ID_BYTES})").alias("ids"),
    )
