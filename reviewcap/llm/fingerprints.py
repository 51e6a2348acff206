"""Document fingerprints by winnowing (DataFrame functions only).

A text's words (runs of at most 16 characters other than white space, in
lower case) are hashed, and neighbouring hashes are combined by doubling into
the hash of every k-gram.  Of each window of ``w`` successive k-grams the
smallest hash is chosen, the rightmost of equal ones, and kept with its
position (the word at which the k-gram begins).  So any run of w + k - 1 words
that two documents share gives at least one hash that both have, at a place
in that run.  A text of fewer than w + k words has a single hash, so its
likeness is all or nothing.

The windows' minima, too, are found by doubling: the minimum of 2 s k-grams
is the smaller of two minima of s.  All steps take time in proportion to the
text; a text's arrays are held in memory one text at a time.

Defined results: a text of fewer than k words has one gram, all its words; a
text without words has no hash, and two such texts are alike (1.0); a text
with fewer grams than a window has one window; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, stored

K, W = 4, 16  # words of a k-gram, k-grams of a window: both powers of two
LOW = (1 << 32) - 1


def _doubled(rows: DataFrame, name: str, to: int, both) -> DataFrame:
    """Column ``name`` (an array), each element combined with those up to ``to`` - 1 places after it."""
    step = 1
    while step < to:
        rows = rows.withColumn(name, F.zip_with(name, F.slice(name, step + 1, F.greatest(F.size(name), F.lit(1))), both))
        step *= 2
    return rows


def with_winnowed(rows: DataFrame, text: Column, name: str, k: int = K, w: int = W) -> DataFrame:
    """``rows`` with column ``name``: an array of (hash of 31 bits) * 2**32 + (2**32 - 1 - position), in order of position."""
    words, grams = f"{name}_words", f"{name}_grams"
    out = rows.withColumn(words, F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\S{1,16}"), F.lit(0)), lambda x: F.xxhash64(x)))
    out = _doubled(out.withColumn(grams, F.col(words)), grams, k, lambda a, b: F.xxhash64(a, b))
    few = F.size(words) < k
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(grams, F.when(few, whole).otherwise(F.slice(grams, 1, F.greatest(F.size(words) - (k - 1), F.lit(1)))))
    # A number whose smallest is the smallest hash and, of equal ones, the rightmost position.
    out = out.withColumn(grams, F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32) + (F.lit(LOW) - i)))
    out = out.withColumn(words, F.size(grams))
    out = _doubled(out, grams, w, lambda a, b: F.least(a, b))
    return out.withColumn(name, F.array_distinct(F.slice(grams, 1, F.greatest(F.col(words) - (w - 1), F.lit(1))))).drop(words, grams)


def shown(winnowed: Column) -> Column:
    """The fingerprint as text: hash@position, in order of position."""
    return F.array_join(F.transform(winnowed, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 32))), F.lit("@"), (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).cast("string"))), " ")


def hashes(winnowed: Column) -> Column:
    return F.array_distinct(F.transform(winnowed, lambda v: F.shiftright(v, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes of two sets; 1.0 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """doc_id, winnowed (array of hash, position) of every row."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_winnowed(rows, F.col("text"), "winnowed", k, w).select(
        "doc_id", F.transform("winnowed", lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("hash"), (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).alias("position"))).alias("winnowed"))


KEYS = ["id", "none", "tie"]  # of a document: its id (0 for null), whether that is null, a hash of its text


def _neighbours(texts: DataFrame) -> DataFrame:
    """KEYS, and as to_id, to_none, to_tie, to_chars the document whose next it is, by descending id.

    Rows that repeat an id and a text are one document here.  The order is that
    of range partitions; the counts before each turn places into ranks.
    """
    order = [F.col("none").asc(), F.col("id").desc(), F.col("tie").desc()]
    keys = texts.groupBy(*KEYS).agg(F.max(F.length("text")).alias("chars"))
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = stored(placed, "document-order")
    whole = Window.orderBy("part")  # one row for each partition
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    ranked = placed.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at"))
    to = ranked.select(*[F.col(c).alias(f"to_{c}") for c in [*KEYS, "chars"]], F.col("rank").alias("to_rank"))
    follows = (F.col("rank") + F.col("total") - 1) % F.col("total")
    return ranked.select(*KEYS, follows.alias("to_rank")).join(to, "to_rank").drop("to_rank")


def against_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 3, k: int = K, w: int = W) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The edited text has the last 1/``part`` of the characters replaced by the
    first as many (or all) of the next document in descending id (after the
    last: the first).  Null ids come last; rows that repeat an id and a text
    have the same next document; a single document is its own next.
    """
    doc = col(id_col).cast("long")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("none"), F.xxhash64(text).alias("tie"), text.alias("text"))
    links = stored(_neighbours(rows), "neighbours")
    # Texts are dealt out once, by KEYS, to send what others need of them and to receive it: both joins read that exchange.
    sent = rows.join(links, KEYS).select("to_id", "to_none", "to_tie", "text", F.floor(F.col("to_chars") / part).cast("int").alias("tail"))
    sent = with_winnowed(sent, F.col("text"), "next", k, w).select(
        *[F.col(f"to_{c}").alias(c) for c in KEYS], F.substr("text", F.lit(1), F.col("tail")).alias("head"), hashes(F.col("next")).alias("next_hashes"))
    sent = sent.groupBy(*KEYS).agg(F.first("head").alias("head"), F.first("next_hashes").alias("next_hashes"))  # copies send the same
    n = F.length("text")
    made = rows.join(sent, KEYS).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), "text", "next_hashes",
        F.concat(F.substr("text", F.lit(1), n - F.floor(n / part).cast("int")), "head").alias("edited"))
    made = with_winnowed(with_winnowed(made, F.col("text"), "own", k, w), F.col("edited"), "changed", k, w)
    made = made.withColumn("own_hashes", hashes(F.col("own")))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own_hashes"), hashes(F.col("changed"))).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"))
