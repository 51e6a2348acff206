"""Rule catalog: one row per review rule, shared by LOSS and PRECISION.

The two programs name the same rule differently and match it differently
(contains-mode LIKE for LOSS, case-insensitive equality for PRECISION), so a
single row carries both spellings.  The row's position is its ``ordinal``:
in contains mode the first matching row wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    loss_label: str
    like_pattern: str
    exact_strings: tuple[str, ...]
    precision_label: str


# ---------------------------------------------------------------------------
# Fixed values.  These must equal the source analysis for results to match:
# rule labels, LIKE patterns (note: ``_`` is a one-character wildcard and two
# patterns have no trailing ``%``), exact rule strings, precision labels and
# the two fallback labels.  Listed in contains-mode match order.
# ---------------------------------------------------------------------------
RULES: tuple[Rule, ...] = (
    Rule("PaymentForRequestRecentlyPublished",
         "%PaymentForRequestRecentlyPublished%",
         ("Rule fired - o_PaymentForRequestRecentlyPublished_REVIEW_MERCHANT",
          "Rule fired - o_PaymentForRequestRecentlyPublished_DECLINE_and_PAUSE_MERCHANT"),
         "Payment for Request"),
    Rule("UniqueCardsRefusedLast24HoursThresholdBreached",
         "%Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_PauseMerchant%",
         ("Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_PauseMerchant",),
         "Unique Cards Single"),
    Rule("UniqueCardsRefusedLast24HoursThresholdBreached_Reusable",
         "%Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_Reusable_PauseMerchant%",
         ("Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_Reusable_PauseMerchant",),
         "Unique Cards Reusable"),
    Rule("UniqueCardsRefusedLast24HoursThresholdBreached_Wisetag",
         "%Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_Wisetag_PauseMerchant%",
         ("Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_Wisetag_PauseMerchant",),
         "Unique Cards Wisetag"),
    Rule("emailAgeScoreAboveThreshold",
         "%Rule fired - o_emailAgeScoreAboveThreshold_ReviewMerchant%",
         ("Rule fired - o_emailAgeScoreAboveThreshold_ReviewMerchant",),
         "Emailage Score"),
    Rule("HighRiskIssuerRefusalReason",
         "%Rule fired - o_HighRiskIssuerRefusalReason_ReviewMerchant%",
         ("Rule fired - o_HighRiskIssuerRefusalReason_ReviewMerchant",),
         "Refusal Reason"),
    Rule("AbuserFlag",
         "%Rule fired - o_PAYFAC_POST_AUTH_PAYFAC_SUB_MERCHANTAbuserFlag_AlertSlack%",
         ("Rule fired - o_PAYFAC_POST_AUTH_PAYFAC_SUB_MERCHANTAbuserFlag_AlertSlack",),
         "AbuserFlag"),
    Rule("AverageDailyPayFacTransactionExceedsAverageDailyTransfer",
         "%Rule fired - o_AverageDailyPayFacTransactionExceedsAverageDailyTransfer_PauseMerchant%",
         ("Rule fired - o_AverageDailyPayFacTransactionExceedsAverageDailyTransfer_PauseMerchant",),
         "PF Transaction Exceeds Average Daily Transfer (Velocity)"),
    Rule("AttemptedAmountExceedsTransferAmount",
         "%Rule fired - o_AttemptedAmountExceedsTransferAmount_PauseMerchant%",
         ("Rule fired - o_AttemptedAmountExceedsTransferAmount_PauseMerchant",),
         "PF Attempt Exceeds Transfer Amount (Velocity)"),
    Rule("Bin6AttemptedVolumeSpike",
         "%Rule fired - o_Bin6AttemptedVolumeSpike_ReviewMerchant%",
         ("Rule fired - o_Bin6AttemptedVolumeSpike_ReviewMerchant",),
         "BIN Spike"),
    Rule("ProtonmailEmailDomain",
         "%Rule fired - o_ProtonmailEmailDomain_PauseMerchant%",
         ("Rule fired - o_ProtonmailEmailDomain_PauseMerchant",),
         "Protonmail"),
    Rule("IssuerAndMerchantConcentration",
         "%Rule fired - o_IssuerAndMerchantConcentration_ReviewMerchant%",
         ("Rule fired - o_IssuerAndMerchantConcentration_ReviewMerchant",),
         "Issuer and Merchant Concentration"),
    Rule("IssuerIcardADPattern",
         "%Rule fired - o_IssuerIcardADPattern_DeclineAndOffboard%",
         ("Rule fired - o_IssuerIcardADPattern_DeclineAndOffboard",),
         "Issuer IcardAD rule"),
    Rule("LTVHigherThresholdBreached",
         "%Rule fired - o_LTVHigherThresholdBreached_PauseMerchant%",
         ("Rule fired - o_LTVHigherThresholdBreached_PauseMerchant",),
         "Higher LTV rule"),
    Rule("LTVLowerThresholdBreached",
         "%Rule fired - o_LTVLowerThresholdBreached_ReviewMerchant%",
         ("Rule fired - o_LTVLowerThresholdBreached_ReviewMerchant",),
         "Lower LTV rule"),
    Rule("PayerDisputeThreshold",
         "%Rule fired - o_PayerDisputeThreshold_ReviewMerchant",
         ("Rule fired - o_PayerDisputeThreshold_ReviewMerchant",),
         "Payer Dispute Threshold"),
    Rule("WithdrawalRule",
         "%Rule fired - o_WithdrawalRule_PauseMerchant",
         ("Rule fired - o_WithdrawalRule_PauseMerchant",),
         "Withdrawal Rule"),
)
LOSS_ELSE_LABEL = "Transaction_amount"
PRECISION_ELSE_LABEL = "Transaction amount"
# --------------------------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class RuleCatalog:
    rules: tuple[Rule, ...] = RULES
    loss_else: str = LOSS_ELSE_LABEL
    precision_else: str = PRECISION_ELSE_LABEL

    def bridge_rows(self) -> list[tuple[str, str]]:
        """(precision_label, loss_label) pairs, including the fallback group."""
        rows = [(r.precision_label, r.loss_label) for r in self.rules]
        rows.append((self.precision_else, self.loss_else))
        return rows


DEFAULT_CATALOG = RuleCatalog()

CATALOG_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("like_pattern", T.StringType(), True),
    T.StructField("exact_strings", T.ArrayType(T.StringType()), True),
    T.StructField("loss_label", T.StringType(), False),
    T.StructField("precision_label", T.StringType(), False),
])


def catalog_from_frame(df: DataFrame) -> RuleCatalog:
    """The catalog that a table of ``CATALOG_SCHEMA`` holds (a parameter table: one row for each rule).

    Rules are matched in the order of ``ordinal``; the one row without a
    pattern names the fallback groups.  Fails on none or more of those, and on
    an ordinal that occurs twice.
    """
    rows = sorted(df.select(*CATALOG_SCHEMA.names).collect(), key=lambda r: r["ordinal"])
    if len({r["ordinal"] for r in rows}) < len(rows):
        raise ValueError("an ordinal of the catalog occurs more than once")
    rest = [r for r in rows if r["like_pattern"] is None]
    if len(rest) != 1:
        raise ValueError(f"the catalog needs one fallback row, not {len(rest)}")
    rules = tuple(Rule(r["loss_label"], r["like_pattern"], tuple(r["exact_strings"] or ()), r["precision_label"])
                  for r in rows if r["like_pattern"] is not None)
    return RuleCatalog(rules, rest[0]["loss_label"], rest[0]["precision_label"])


def catalog_frame(spark: SparkSession, catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """The catalog as a DataFrame (|rules| + 1 rows, the fallback row has no pattern)."""
    rows = [(i + 1, i + 1, r.like_pattern, list(r.exact_strings), r.loss_label, r.precision_label)
            for i, r in enumerate(catalog.rules)]
    n = len(rows) + 1
    rows.append((n, n, None, None, catalog.loss_else, catalog.precision_else))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
