"""A training-data pipeline over ``documents``: language ID, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents;
the last returns the packed pieces.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewcap.llm import bpe, exact_dedup, language_id, ngram_join, packing
from reviewcap.llm.common import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the pages of the corpus are evidence."""
    return language_id.identified(docs, language_id.page_evidence(documents(spark, sf_dir, "pages")))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: one with the largest id."""
    return exact_dedup.one_of_each(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle similarity 0.8: the one with the smallest id."""
    return ngram_join.without_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of 4096 tokens."""
    pieces = packing.pack(docs, bpe.vocabulary_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact_duplicates),
    ("near dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

# Language identification and token ids are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
