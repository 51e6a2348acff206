"""The registered queries of this subpackage and, where SQL can say them, their DuckDB restatements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, conversation_repair, exact_dedup, filter_audit, fingerprints, huffman, language_id, ngram_join, packing, pieces, secret_scan, sharding,
               url_filter)
from .common import documents, stored


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.vocabulary_path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(documents(spark, sf_dir), path)
    return pieces.decode_pieces(encoded, path).select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                                                      "score", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = documents(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    made = chat.format_chat(turns.unionByName(planted))
    read = made.select("conv_id", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(documents(spark, sf_dir), language_id.page_evidence(documents(spark, sf_dir, "pages")))
    return found.select("doc_id", "lang", "posterior", "text_lang", "declared", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(documents(spark, sf_dir), ["lang", "source", "n_chars"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.labelled_pages(documents(spark, sf_dir, "pages"), documents(spark, sf_dir, "labels"))
    return url_filter.judge_pages(pages)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = stored(huffman.token_ids(documents(spark, sf_dir), bpe.vocabulary_path("byte_bpe_50k.json"), end_id=0), "ids")
    return huffman.read_token_files(huffman.write_token_files(ids)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), k=4, percent=85)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edited(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), bpe.vocabulary_path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations")
    found, edits = conversation_repair.repair(conversation_repair.damaged(turns))
    own = found.join(conversation_repair.digests(edits).withColumnRenamed("conv_id", "edited_id"), F.col("conv_id").eqNullSafe(F.col("edited_id"))).drop("edited_id")
    every = turns.select(F.col("conv_id").alias("every_id")).distinct()
    joined = every.join(own, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("every_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    counts = [secret_scan.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES = {q.__name__: q for q in (op1_exact_dedup, op2_sentencepiece, op3_chat_format, op4_language_id, op5_sharding, op6_url_filter, op7_token_files, op8_ngram_join, op9_fingerprints, op10_packing,
                                   op11_conversation_repair, op12_secret_scan, op13_filter_audit)}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op3_chat_format": chat.ORACLE, "op6_url_filter": url_filter.ORACLE, "op8_ngram_join": ngram_join.ORACLE,
           "op11_conversation_repair": conversation_repair.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
