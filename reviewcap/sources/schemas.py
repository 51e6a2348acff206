"""Declared schemas of the inputs and cheap structural checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DD_CASE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("reference_id", T.StringType()),
    T.StructField("time_created", T.TimestampNTZType()),
    T.StructField("case_type", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("metadata", T.StringType()),
])
CASE_CARRIED = ("reference_type", "last_updated", "creator")

CASE_STATE_CHANGE = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("time_created", T.TimestampNTZType()),
    T.StructField("actor", T.StringType()),
])

MERCHANTS = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("date_offboarded", T.DateType()),
    T.StructField("offboarding_reason", T.StringType()),
    T.StructField("deactivation_reason", T.StringType()),
    T.StructField("profile_onboarding_status", T.StringType()),
])

PAYMENTS = T.StructType([
    T.StructField("card_attempt_id", T.LongType()),
    T.StructField("profile_id", T.StringType()),
    T.StructField("attempt_time", T.TimestampNTZType()),
    T.StructField("attempted_gbp_amount_gross", T.DecimalType(18, 2)),
    T.StructField("fraud_flag", T.BooleanType()),
    T.StructField("chargeback_amount_gbp", T.DecimalType(18, 2)),
    T.StructField("successful_transaction_flag", T.StringType()),
    T.StructField("payment_request_id", T.LongType()),
    T.StructField("psp_reference", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("payment_request_id", T.LongType()),
    T.StructField("psp_reference", T.StringType()),
])

RULE_INPUTS = T.StructType([
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("rule_precision_l3m", T.DoubleType()),
    T.StructField("per_case_precision", T.DoubleType()),
    T.StructField("avg_cases_per_month", T.IntegerType()),
    T.StructField("avg_handling_time_minutes", T.IntegerType()),
    T.StructField("current_review_type", T.StringType()),
])

SCHEMAS = {
    "dd_case": DD_CASE,
    "case_state_change": CASE_STATE_CHANGE,
    "merchants": MERCHANTS,
    "payments": PAYMENTS,
    "requests": REQUESTS,
    "rule_inputs": RULE_INPUTS,
}


def lower_columns(df: DataFrame) -> DataFrame:
    """Normalise column names to lower case (the warehouse returns upper case)."""
    return df.toDF(*[c.lower() for c in df.columns])


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """Fail fast (at plan time, no job) when a required column is missing."""
    missing = [f.name for f in SCHEMAS[table].fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Lower-case names and cast the required columns to the declared types."""
    df = require_columns(lower_columns(df), table)
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in SCHEMAS[table].fields}
    return df.withColumns(casts)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once (lazy; an empty result means unique).

    Duplicate merchant rows fan out payments in the loss join, exactly as in
    the source analysis; nothing dedupes them silently, so check with this.
    """
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def assert_unique(df: DataFrame, *keys: str) -> None:
    """Raise if ``keys`` is not unique in ``df`` (runs one aggregation job)."""
    dup = duplicate_keys(df, *keys).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {keys}: {dup[0].asDict()}")
