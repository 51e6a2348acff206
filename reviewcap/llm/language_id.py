"""Language identification by fusing the evidence on a document.

* Text: byte 4-grams of the letters, a naive Bayes model for each language.
  Labels are counted over all rows: one with ``LEAST_ROWS`` rows is a language
  at any size.  The model is fitted on a sample of labelled rows (whole texts,
  chosen by a hash of id and text): ``SAMPLE`` over all labels, and as many
  again dealt out evenly to the languages, so each is fitted however rare it
  is.  A text's mean evidence counts
  as that of ``EFFECTIVE`` independent grams at most, as neighbouring grams
  are not independent.  The class ``und`` (no known language) has every gram
  equally likely.
* Declared: the language that the page's markup states.
* Address: the language code in the address (a two-letter first folder, or
  the country code at its end).
* Host: how often each language occurs on the host, shrunk to its registered
  domain, that to its suffix, and that to all documents.

The rates of the last three are counted over all documents, by the language
that the text alone shows, in grouped aggregations; so they need no labels
and grow with the corpus.  The posterior is the product of all evidence.  A
document is kept when its most likely class is a language with a posterior of
at least ``LEAST``.

Defined results: a text without letters has no text evidence and is ``und``
(not kept), whatever else is declared; null evidence says nothing; a null or
unlabelled language is not sampled; with no labelled row at all no language
is known and nothing is kept; rows that repeat an id are judged each by the
id's evidence; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import batches, release
from .common import col, stored

GRAM_BITS = 16  # hashed 4-grams: 2**16 of them
SAMPLE = 4000  # labelled documents that the model is fitted on, over all labels and again evenly by language
LEAST_ROWS = 5  # labelled documents that make a label a language
EFFECTIVE = 200.0
PRIOR_ROWS = 20.0  # documents that the level above counts as
UND, UND_PRIOR = "und", 1e-3
LEAST = 0.5
KEPT_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-grams of all texts that begin with a letter, and the text of each."""
    raw = [(" " + t + "   ").lower().encode("utf-8", "replace").translate(KEPT_BYTES) for t in texts]
    own = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    if len(own) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(raw)), [len(r) for r in raw])[:-3]
    code = own[:-3] | own[1:-2] << np.uint32(8) | own[2:-1] << np.uint32(16) | own[3:] << np.uint32(24)
    hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    at = own[:-3] != 32
    return hashed[at].astype(np.int64), text[at]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each gram (a row a gram, ``und`` last) from rows (key, text, label)."""
    rows = labelled.filter("label IS NOT NULL").withColumn("order", F.xxhash64("key", "text"))
    last = rows.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]  # the sample-th smallest hash
    known = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ROWS)
    languages = sorted(r["label"] for r in known.collect())
    # The row with the smallest hash of each of so many parts of a language: a grouped minimum, however many rows it has.
    share = max(LEAST_ROWS, sample // max(len(languages), 1))
    own = rows.filter(F.col("label").isin(languages)).groupBy("label", F.pmod("order", F.lit(share)).alias("part")).agg(F.min("order").alias("order"))
    own = own.select(F.col("label").alias("own_label"), F.col("order").alias("own_order"))
    rows = rows.join(F.broadcast(own), (F.col("label") == F.col("own_label")) & (F.col("order") == F.col("own_order")), "left")
    rows = rows.filter((F.col("order") <= F.lit(last)) | F.col("own_order").isNotNull()).select("label", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            labels = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for label in set(labels):
                own = [t for x, t in zip(labels, texts) if x == label]
                counts = np.zeros(1 << GRAM_BITS, np.int64)
                for s in batches(own):
                    counts += np.bincount(_grams(own[s])[0], minlength=1 << GRAM_BITS)
                seen = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([label] * (len(seen) + 1), pa.string()), pa.array([*seen.tolist(), -1], pa.int32()), pa.array([*counts[seen].tolist(), len(own)], pa.int64())], ["label", "gram", "n"])

    # At most 2**GRAM_BITS rows for each label of the sample.
    got = rows.mapInArrow(count, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).collect()
    counts = np.full((1 << GRAM_BITS, len(languages) + 1), 0.5)
    place = {c: i for i, c in enumerate(languages)}
    for r in got:
        if r["gram"] >= 0 and r["label"] in place:
            counts[r["gram"], place[r["label"]]] += r["n"]
    counts[:, -1] = 1.0
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """key, tie, origin, n_grams, evidence (array, a log-likelihood for each language and ``und``) of rows (key, tie, origin, text)."""
    width = len(languages) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for s in batches(texts):
                own = texts[s]
                grams, text = _grams(own)
                n = np.bincount(text, minlength=len(own))
                # Without any gram (a batch of empty texts) bincount gives whole numbers.
                sums = np.stack([np.bincount(text, model[grams, j], minlength=len(own)) for j in range(width)], axis=1).astype(np.float64)
                sums *= np.where(n > 0, np.minimum(1.0, EFFECTIVE / np.maximum(n, 1)), 0.0)[:, None]
                k = len(own)
                values = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
                yield pa.record_batch([*(batch.column(i).slice(s.start, k) for i in range(3)), pa.array(n, pa.int64()), values], ["key", "tie", "origin", "n_grams", "evidence"])

    return rows.select("key", "tie", "origin", "text").mapInArrow(run, "key long, tie long, origin string, n_grams long, evidence array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """key, declared, address, host: what the pages say of the document whose number ends their address.

    Of several pages of a document the one with the smallest id counts.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^.*?://([^/?#:]*)", 1))
    folder = F.regexp_extract(url, r"^.*?://[^/?#]*/([A-Za-z]{2})(?:/|$)", 1)
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    declared = F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    some = lambda c: F.when(c != "", F.lower(c))
    rows = pages.select(F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/?#]*/?(?:[?#].*)?$', 1) AS BIGINT)").alias("key"),
                        F.struct("page_id", some(declared).alias("declared"), F.coalesce(some(folder), some(country)).alias("address"), some(host).alias("host")).alias("page"))
    found = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("page").alias("page"))
    return found.select("key", "page.declared", "page.address", "page.host")


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def identify(docs: DataFrame, evidence: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str | None = "source",
             least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """doc_id, tie (hash of the text), lang, posterior, text_lang, declared, kept of every row of ``docs``.

    ``evidence``: key, declared, address, host (one row a document at most).
    ``host_col`` stands for the host of documents without one there.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"), col(label_col).cast("string").alias("label"),
                       (col(host_col).cast("string") if host_col else F.lit(None).cast("string")).alias("origin"))
    languages, model = fit(rows.select("key", "text", "label"), sample)
    classes = [*languages, UND]
    k = len(languages)
    scored = text_evidence(rows, languages, model)
    # The text's evidence is a few numbers a document: stored once, read for the counts and for the result.
    scored = stored(scored, "text-evidence")
    joined = scored.join(evidence.withColumnRenamed("key", "page_key"), F.col("key") == F.col("page_key"), "left").drop("page_key")
    names = F.array(*[F.lit(c) for c in classes])
    known = F.array(*[F.lit(c) for c in languages]).cast("array<string>")
    one_of = lambda c: F.when(c.isNull(), c).when(F.array_contains(known, c), c).otherwise("other")
    joined = joined.select("key", "tie", "n_grams", "evidence", F.col("declared").alias("said"), one_of(F.col("declared")).alias("declared"), one_of(F.col("address")).alias("address"),
                           F.coalesce("host", "origin", F.lit("")).alias("host"), F.get(names, _argmax(F.col("evidence")).cast("int")).alias("text_lang"))
    joined = stored(joined.withColumn("text_lang", F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(F.col("text_lang"))), "evidence")

    # Rates of statements given the language: (languages + 1) squared numbers at most go to the driver.
    def rates(name: str) -> dict[tuple[str, str], float]:
        seen = joined.filter(F.col(name).isNotNull()).groupBy(name, "text_lang").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {(r[name], r["text_lang"]): r["n"] for r in seen}
        values = [*languages, "other"]
        out = {}
        for c in classes:
            own = [counts.get((v, c), 0) for v in values]
            out |= {(v, c): float(np.log((n + 1) / (sum(own) + len(values)))) for v, n in zip(values, own)}
        return out

    # Host priors: counts by language of each host, shrunk level by level.
    per = [F.sum((F.col("text_lang") == c).cast("long")).alias(f"n{i}") for i, c in enumerate(languages)]
    hosts = joined.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *per)
    hosts = hosts.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    sums = [F.sum(c).alias(c) for c in ("n", *[f"n{i}" for i in range(k)])]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()  # one row
    share = lambda i, above: (F.col(f"n{i}") + PRIOR_ROWS * above) / (F.col("n") + PRIOR_ROWS)
    base = [((total[f"n{i}"] or 0) + 1.0) / ((total["n"] or 0) + k + 1.0) for i in range(k)]
    suffixes = suffixes.select("suffix", *[share(i, F.lit(base[i])).alias(f"s{i}") for i in range(k)])
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", *[share(i, F.col(f"s{i}")).alias(f"d{i}") for i in range(k)])
    hosts = hosts.join(domains, ["suffix", "domain"]).select(
        "host", F.xxhash64("host").alias("digest"), F.array(*[F.ln(F.greatest(share(i, F.col(f"d{i}")), F.lit(1e-12))) for i in range(k)], F.lit(float(np.log(UND_PRIOR)))).alias("prior"))

    # Joining on the digest too deals out both sides anew, so that Spark can split a large host's rows.
    full = joined.withColumn("digest", F.xxhash64("host")).join(hosts, ["digest", "host"])
    terms = [F.col("evidence"), F.col("prior")]
    for name in ("declared", "address"):
        table = rates(name)
        said = F.lit(None).cast("array<double>")
        for v in [*languages, "other"]:
            said = F.when(F.col(name) == v, F.array(*[F.lit(table[v, c]) for c in classes])).otherwise(said)
        terms.append(F.coalesce(said, F.array(*[F.lit(0.0)] * len(classes))))
    summed = terms[0]
    for t in terms[1:]:
        summed = F.zip_with(summed, t, lambda a, b: a + b)
    full = full.withColumn("all", summed).withColumn("top", F.array_max("all"))
    posterior = 1 / F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    lang = F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(F.get(names, _argmax(F.col("all")).cast("int")))
    return full.select(F.col("key").alias("doc_id"), "tie", lang.alias("lang"), F.round(posterior, 6).alias("posterior"), "text_lang", F.col("said").alias("declared")).withColumn(
        "kept", (F.col("lang") != UND) & (F.col("posterior") >= least))


def identified(docs: DataFrame, evidence: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    lost = identify(docs, evidence, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_lost_id"), F.col("tie").alias("_lost_tie")).distinct()
    tie = F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit("")))
    return docs.join(lost, col(id_col).cast("long").eqNullSafe(F.col("_lost_id")) & (tie == F.col("_lost_tie")), "left_anti")
