"""Planning inputs: the per-rule table the planner scores and assigns.

Carried as a DataFrame keyed by rule name (never aligned by position), with
optional planning-unit columns so many teams, regions or budget scenarios are
planned in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewcap.operators.scoring import dealt_by_unit
from reviewcap.params import REVIEW_TYPES
from reviewcap.sources.schemas import RULE_INPUTS, conform

# ---------------------------------------------------------------------------
# The published planning inputs, in their original order —
# rule name, rule precision over the last three months (%), per-case
# precision (%), average cases per month, average handling time (minutes),
# current review type.
# ---------------------------------------------------------------------------
PUBLISHED_RULE_INPUTS = (
    ("AttemptedAmountExceedsTransferAmount", 67.82, 52.17, 23, 20, "Standard"),
    ("AverageDailyPayFacTransactionExceedsAverageDailyTransfer", 74.13, 40.63, 292, 35, "Standard"),
    ("Bin6AttemptedVolumeSpike", 71.0, 29.03, 32, 23, "Standard"),
    ("HighRiskIssuerRefusalReason", 69.23, 50.00, 10, 29, "Standard"),
    ("IssuerAndMerchantConcentration", 44.32, 25.00, 27, 26, "Standard"),
    ("IssuerIcardADPattern", 100.0, 100.00, 1, 36, "Standard"),
    ("LTVHigherThresholdBreached", 30.77, 0.00, 9, 110, "Deep"),
    ("LTVLowerThresholdBreached", 41.95, 39.39, 67, 33, "Deep"),
    ("PayerDisputeThreshold", 94.44, 0.00, 7, 19, "Standard"),
    ("PaymentForRequestRecentlyPublished", 62.5, 41.18, 14, 46, "Standard"),
    ("ProtonmailEmailDomain", 58.82, 42.86, 14, 21, "Standard"),
    ("UniqueCardsRefusedLast24HoursThresholdBreached", 84.62, 60.00, 10, 42, "Standard"),
    ("UniqueCardsRefusedLast24HoursThresholdBreached_Reusable", 78.95, 38.46, 20, 38, "Standard"),
    ("UniqueCardsRefusedLast24HoursThresholdBreached_Wisetag", 83.33, 71.43, 6, 32, "Standard"),
    ("WithdrawalRule", 55.74, 40.12, 77, 32, "Standard"),
    ("emailAgeScoreAboveThreshold", 83.87, 43.75, 13, 23, "Standard"),
    ("Transaction_amount", 50.67, 13.04, 67, 16, "Standard"),
)
# Published per-rule average loss per problematic merchant for the five
# top-loss rules (whole pounds); other rules have none.
PUBLISHED_TOP5_LOSS = (
    ("AttemptedAmountExceedsTransferAmount", 22989.0),
    ("PaymentForRequestRecentlyPublished", 11165.0),
    ("AverageDailyPayFacTransactionExceedsAverageDailyTransfer", 1204.0),
    ("Transaction_amount", 7395.0),
    ("Bin6AttemptedVolumeSpike", 1762.0),
)
# --------------------------------------------------------------------------- end of fixed values

LOSS_SCHEMA = T.StructType([
    T.StructField("rule_group", T.StringType(), False),
    T.StructField("avg_fraud_per_problematic_merchant", T.DoubleType()),
])


def published_rule_inputs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED_RULE_INPUTS), RULE_INPUTS)


def published_top5_loss(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED_TOP5_LOSS), LOSS_SCHEMA)


def validated_rule_inputs(df: DataFrame, units: Sequence[str] = ()) -> DataFrame:
    """A user-kept parameter table, checked as it is read.

    Fails (when a row is read) on a review type that is not Light, Standard or
    Deep, on a missing rule name, cases or minutes, and on a rule that occurs
    twice in a unit.  A missing precision is allowed: such a rule has no score.
    """
    df = conform(df, "rule_inputs")

    def fail(text: str, value: F.Column) -> F.Column:
        return F.raise_error(F.concat(F.lit(text), F.coalesce(value.cast("string"), F.lit("NULL"))))

    name, kind = F.col("rule_name"), F.col("current_review_type")
    checked = df.withColumn("current_review_type", F.when(kind.isin(*REVIEW_TYPES), kind).otherwise(
        fail("unknown review type: ", kind).cast("string")))
    for c in ("rule_name", "avg_cases_per_month", "avg_handling_time_minutes"):
        checked = checked.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
            fail(f"no {c} for rule ", name).cast(df.schema[c].dataType)))
    keys = [*units, "rule_name"]
    others = [c for c in checked.columns if c not in keys]
    # One row a rule and unit: a group of one row gives it back, a larger one fails.
    one = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_row"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        fail("more than one row for rule ", name).cast(one.schema["_row"].dataType))
    return one.select(*keys, row.alias("_row")).select(*keys, "_row.*").select(*checked.columns)


def load_rule_inputs(spark: SparkSession, path: str, units: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """The parameter table (rule inputs, and unit columns if any) stored at ``path``, dealt out by unit and validated."""
    return validated_rule_inputs(dealt_by_unit(spark.read.format(fmt).load(path), units), units)


def _input_structs() -> F.Column:
    return F.array(*[
        F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("rule_name"),
                 F.lit(l3m).alias("rule_precision_l3m"), F.lit(pc).alias("per_case_precision"),
                 F.lit(cases).alias("avg_cases_per_month"), F.lit(aht).alias("avg_handling_time_minutes"),
                 F.lit(cur).alias("current_review_type"))
        for pos, (name, l3m, pc, cases, aht, cur) in enumerate(PUBLISHED_RULE_INPUTS)
    ])


def unit_portfolios(customer: DataFrame) -> DataFrame:
    """One planning unit per customer (FIXTURES.md "Many units").

    Each unit gets the published rules (a bounded fan-out of |rules| rows per
    customer, written as a generator, not a cartesian join), a budget of
    ``60 + key % 60`` hours and case volumes ``cases + (key*7 + pos) % 13``.
    Columns: unit, budget_weekly_hours, pos and the rule-input columns.
    """
    k = F.col("c_custkey")
    rows = customer.select(k.alias("unit"), F.inline(_input_structs()))
    return rows.select(
        "unit",
        (F.lit(60) + F.col("unit") % 60).cast("double").alias("budget_weekly_hours"),
        "pos", "rule_name", "rule_precision_l3m", "per_case_precision",
        (F.col("avg_cases_per_month") + (F.col("unit") * 7 + F.col("pos")) % 13).cast("int")
        .alias("avg_cases_per_month"),
        F.col("avg_handling_time_minutes").cast("int").alias("avg_handling_time_minutes"),
        "current_review_type",
    )
