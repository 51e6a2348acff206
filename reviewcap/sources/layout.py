"""Storage layout for repeated runs at scale: co-locate the loss join, keep skew split.

``store_review_tables`` writes the five review tables as catalog tables:

* payments — the largest table — bucketed by ``(profile_id, _salt)`` where
  ``_salt`` spreads each merchant's payments over ``salt_buckets`` values.
  LOSS then joins without shuffling payments at all, and a merchant holding
  a third of all payments is split over ``salt_buckets`` buckets instead of
  landing in one task (AQE cannot split a bucketed scan, so plain
  ``profile_id`` bucketing would not survive that skew);
* merchants bucketed by ``profile_id`` (one row per merchant, no skew);
* cases, case events and requests unbucketed, sorted by their time / key, so
  scans split evenly, time filters skip row groups and partial aggregation
  absorbs hot keys before any shuffle.

Run LOSS on the stored tables with ``LossParams(salt_buckets=<same S>)``: the
small first-case side is replicated S times to meet the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewcap.sources.tables import ReviewTables

SALT_COL = "_salt"


def salted(payments: DataFrame, salt_buckets: int) -> DataFrame:
    """Payments with a stable salt in ``[0, salt_buckets)`` derived from the attempt id."""
    return payments.withColumn(SALT_COL, F.pmod(F.xxhash64("card_attempt_id"), F.lit(salt_buckets)))


def store_review_tables(spark: SparkSession, tables: ReviewTables, prefix: str, payment_buckets: int,
                        salt_buckets: int, merchant_buckets: int | None = None,
                        mode: str = "overwrite") -> ReviewTables:
    """Write the layout above as ``{prefix}dd_case`` ... tables and return them read back.

    Bucket counts: size ``payment_buckets`` so one bucket of payments is a few
    hundred MB; ``merchant_buckets`` defaults to the same count so the merchant
    join needs no shuffle of either side.
    """
    merchant_buckets = merchant_buckets or payment_buckets
    (salted(tables.payments, salt_buckets).write.mode(mode).format("parquet")
     .bucketBy(payment_buckets, "profile_id", SALT_COL).sortBy("profile_id", "attempt_time")
     .saveAsTable(f"{prefix}payments"))
    (tables.merchants.write.mode(mode).format("parquet")
     .bucketBy(merchant_buckets, "profile_id").sortBy("profile_id")
     .saveAsTable(f"{prefix}merchants"))
    for name, key in (("dd_case", "time_created"), ("case_state_change", "case_id"),
                      ("requests", "payment_request_id")):
        (getattr(tables, name).sortWithinPartitions(key).write.mode(mode).format("parquet")
         .saveAsTable(f"{prefix}{name}"))
    names = {n: f"{prefix}{n}" for n in ("dd_case", "case_state_change", "merchants", "payments", "requests")}
    return ReviewTables.from_catalog(spark, names)
