"""Exact duplicates by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks whose borders its own content decides: after at
least ``least`` characters, at the next line or sentence end, or after
``most`` characters.  Equal texts have equal chunks.  Every distinct chunk of
the corpus gets an identifier: its 64-bit hash and, where chunks with the
same hash differ, its rank among them.  The distinct chunks are compared as
texts to find such cases, so identifiers are verified, and documents are
compared by their ordered lists of identifiers: long documents move once, in
chunks, of which copies are merged before they move.

Defined results: a null text counts as empty, and empty texts are copies of
each other; the row with the largest document id stays; a null document id
stays only where all ids of its group are null; rows that repeat a document
id and its text are the same document: each counts in ``group_size`` and they
share the decision; an empty table gives no row; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, one_of_repeated, stored


def chunks(text: Column, least: int, most: int) -> Column:
    """The chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least}}}[^\n.!?]{{0,{most - least}}}[\n.!?]?|.+"), F.lit(0))


def chunk_store(texts: DataFrame, least: int, most: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """hash, chunk: every distinct chunk of the column ``text``."""
    each = texts.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk"))
    return each.groupBy(hashed(F.col("chunk")).alias("hash"), "chunk").agg(F.count(F.lit(1)).alias("n")).select("hash", "chunk")


def recipes(texts: DataFrame, least: int, most: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered verified identifiers of each text's chunks."""
    store = chunk_store(texts, least, most, hashed)
    shared = stored(store.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "shared-hashes")
    parts = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), least, most).alias("chunks"))
    if shared.isEmpty():  # every hash has one chunk: it is the identifier
        return parts.select("doc_id", "text_sha256", F.transform("chunks", lambda c: hashed(c)).alias("recipe"))
    ranks = store.join(shared, "hash").select("hash", "chunk", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).alias("rank"))
    rows = parts.select(F.monotonically_increasing_id().alias("row"), "*")
    each = rows.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk")).withColumn("hash", hashed(F.col("chunk")))
    named = each.join(ranks, ["hash", "chunk"], "left")
    item = F.struct("pos", "hash", F.coalesce("rank", F.lit(0)).alias("rank"))
    lists = named.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"),
                                     F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("items"))
    return lists.select("doc_id", "text_sha256", F.transform("items", lambda x: F.struct(x["hash"], x["rank"])).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 512, most: int = 2048,
                     hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``hashed`` gives a chunk's provisional identifier; a weak one costs time, not correctness.
    """
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    made = stored(recipes(texts, least, most, hashed), "recipes").withColumn("digest", F.xxhash64("recipe"))
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # Joining on the digest too deals out both sides anew, so that Spark can split a large group's rows.
    groups = groups.withColumn("digest", F.xxhash64("recipe"))
    named = made.join(groups, ["digest", "recipe"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return named.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    lost = exact_duplicates(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_lost_id"), F.col("text_sha256").alias("_lost_sha"))
    sha = F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256)
    return docs.join(lost, col(id_col).cast("long").eqNullSafe(F.col("_lost_id")) & (sha == F.col("_lost_sha")), "left_anti")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each text, with all its columns: one with the largest id (null only where all ids are)."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept AND group_size > 1")
    again = kept.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_sha256")
    sha = F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256)
    return one_of_repeated(without_duplicates(docs, id_col, text_col), col(id_col).cast("long"), sha, again)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce("text", '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
