"""The registered queries and the pipeline on the smallest tables."""

import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import brute
import corpus_pipeline
from compare import compare
from conftest import SF001, SF01
from reviewcap.llm import language_id, queries
from reviewcap.llm.common import documents

NATIVE = ("op1_exact_dedup", "op3_chat_format", "op5_sharding", "op9_fingerprints")


def test_registered():
    names = set(E.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(E.queries()[name](spark, SF001), E.oracle_sql()[name], SF001)
    assert r["cols_match"] and r["rows"][0] == r["rows"][1] and r["hash_match"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language_held_out(spark):
    got = E.queries()["op4_language_id"](spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("i"), F.col("lang").alias("truth"))
    right = got.join(docs, F.col("doc_id") == F.col("i")).agg(F.avg((F.col("lang") == F.col("truth")).cast("int")).alias("a"), F.avg(F.col("kept").cast("int")).alias("k")).first()
    assert right.a > 0.95 and right.k > 0.95


def test_language_unseen_documents(spark):
    """The model is fitted on one half of the labelled documents and judged on the other."""
    docs = documents(spark, SF01).withColumn("unseen", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    shown = docs.withColumn("lang", F.when(~F.col("unseen"), F.col("lang")))
    got = language_id.identify(shown, language_id.page_evidence(documents(spark, SF01, "pages"))).select("doc_id", F.col("lang").alias("found"))
    judged = docs.filter("unseen").join(got, "doc_id").agg(F.avg((F.col("found") == F.col("lang")).cast("int")).alias("a"), F.count("lang").alias("n")).first()
    assert judged.n > 200 and judged.a > 0.95, judged


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = corpus_pipeline.identify_language(spark, docs, SF001)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids) >= 0.95 * len(texts)
    exact = {r.doc_id for r in corpus_pipeline.drop_exact_duplicates(spark, kept, SF001).collect()}
    assert exact == {max(i for i in ids if texts[i] == t) for t in {texts[i] for i in ids}}
    remaining = docs.filter(F.col("doc_id").isin(*exact))
    near = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, remaining, SF001).collect()}
    assert near == {v[1] for v in brute.joined([(i, texts[i]) for i in exact], 5, 80).values()}
    pieces = corpus_pipeline.run(spark, SF001).collect()
    assert {r.doc_id for r in pieces} == near
    assert sum(r.length for r in pieces) == sum(len(brute.ids_of("word_bpe_49k.json", texts[i], 2)) for i in near)


def test_pipeline_odd_rows(spark, tmp_path):
    """Repeated rows, null ids, null and empty texts, columns with the names of working columns; an empty table."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    more = docs.limit(20).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    blank = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    odd = docs.unionByName(more).unionByName(blank)
    for name in ("node", "component", "k1", "n", "size", "digest"):
        odd = odd.withColumn(name, F.lit("x"))
    spark.read.parquet(f"{SF001}/pages.parquet").write.parquet(f"{tmp_path}/odd/pages.parquet")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    tokens: dict = {}
    for r in pieces:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    named = {i: n for i, n in tokens.items() if i in texts}
    assert len(named) >= 0.8 * len(set(texts.values())) and all(n == len(brute.ids_of("word_bpe_49k.json", texts[i], 2)) for i, n in named.items())
    assert len({texts[i] for i in named}) == len(named)
    spark.read.parquet(f"{SF001}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.columns == list(pieces[0].asDict()) and empty.count() == 0


def test_rest_of_the_library_does_not_need_this():
    import pathlib
    root = pathlib.Path(E.__file__).parent / "reviewcap"
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and "reviewcap.llm" in p.read_text()]
    assert not users and sys.modules["reviewcap"]
