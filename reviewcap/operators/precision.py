"""PRECISION: flagged, offboarded and deactivated merchants per rule, last N months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewcap.catalog import DEFAULT_CATALOG, RuleCatalog
from reviewcap.functions import classify_exact, half_open_window, not_equal_keep_null, pct_half_up, upper_eq
from reviewcap.functions.predicates import not_in_keep_null
from reviewcap.operators.cases import case_review_times, case_turnaround
from reviewcap.operators.facts import present_rules, window_cases
from reviewcap.params import PrecisionParams, as_of_col

MERCHANT_COLS = ("profile_id", "date_offboarded", "offboarding_reason", "deactivation_reason",
                 "profile_onboarding_status")


def payfac_dd_cases(dd_case: DataFrame, case_state_change: DataFrame, params: PrecisionParams,
                    carry: Sequence[str] = ()) -> DataFrame:
    """D4 + D5: review times and turnaround of the cases of the precision case types."""
    return case_turnaround(case_review_times(dd_case, case_state_change, params.case_types, carry))


def merchant_filter(params: PrecisionParams):
    """Excluded profiles (NULL ids pass) AND an accepted status (NULL status fails)."""
    pid = F.col("profile_id")
    status = F.upper(F.col("profile_onboarding_status"))
    return not_in_keep_null(pid, params.excluded_profiles) & status.isin([s.upper() for s in params.statuses])


def request_payment_merchant_spine(requests: DataFrame, payments: DataFrame, merchants: DataFrame,
                                   params: PrecisionParams, apply_filter: bool = True) -> DataFrame:
    """J4 + J5 + P11 + P12 as written: requests FULL JOIN payments FULL JOIN merchants, filtered.

    Catalyst turns both full joins into right joins because the filter
    rejects rows without a merchant.  Row level; callers aggregate
    (``spine_per_merchant`` gives the per-merchant counts without forming it).
    """
    r = requests.select(F.col("payment_request_id").alias("r_payment_request_id"),
                        F.col("psp_reference").alias("r_psp_reference"))
    p = payments.select(F.col("payment_request_id").alias("p_payment_request_id"),
                        F.col("psp_reference").alias("p_psp_reference"),
                        F.col("profile_id").alias("p_profile_id"), "card_attempt_id")
    m = merchants.select(*MERCHANT_COLS)
    rp = r.join(p, (F.col("r_payment_request_id") == F.col("p_payment_request_id"))
                & (F.col("r_psp_reference") == F.col("p_psp_reference")), "full")
    spine = rp.join(m, F.col("profile_id") == F.col("p_profile_id"), "full")
    return spine.filter(merchant_filter(params)) if apply_filter else spine


def spine_per_merchant(requests: DataFrame, payments: DataFrame, merchants: DataFrame,
                       params: PrecisionParams) -> DataFrame:
    """Spine rows, request rows and payment rows per merchant row, without forming the spine.

    Equal to grouping the filtered spine by merchant columns.  Requests are
    matched to payments first (keyed by request id, not by merchant), the
    pairs are counted per payment profile - partial aggregation collapses a
    merchant with a third of all payments before any shuffle - and only then
    attached to merchants.  A merchant with no payment is one spine row.
    """
    r = requests.select(F.col("payment_request_id").alias("r_payment_request_id"),
                        F.col("psp_reference").alias("r_psp_reference"))
    p = payments.select(F.col("payment_request_id").alias("p_payment_request_id"),
                        F.col("psp_reference").alias("p_psp_reference"),
                        F.col("profile_id").alias("p_profile_id"), "card_attempt_id")
    # Requests without a payment cannot reach a merchant: a right join keeps what can.
    rp = r.join(p, (F.col("r_payment_request_id") == F.col("p_payment_request_id"))
                & (F.col("r_psp_reference") == F.col("p_psp_reference")), "right")
    per_profile = rp.groupBy("p_profile_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("r_payment_request_id").alias("_req"),
        F.count("card_attempt_id").alias("_pay"))
    m = merchants.select(*MERCHANT_COLS).filter(merchant_filter(params))
    j = m.join(per_profile, F.col("profile_id") == F.col("p_profile_id"), "left")
    return j.groupBy(*MERCHANT_COLS).agg(
        F.sum(F.coalesce(F.col("_rows"), F.lit(1))).cast("long").alias("spine_rows"),
        F.sum(F.coalesce(F.col("_req"), F.lit(0))).cast("long").alias("request_rows"),
        F.sum(F.coalesce(F.col("_pay"), F.lit(0))).cast("long").alias("payment_rows"),
    )


def case_flags(cases: DataFrame, params: PrecisionParams, by: Sequence[str] = ()) -> DataFrame:
    """Classified cases (``rule_group``) pre-aggregated to one row per (profile, rule group) with three flags.

    flag_assigned: a flag-type case assigned in the window; flag_closed: the
    same and closed; flag_created: a flag-type case created in the window.
    A hot merchant collapses map-side to at most |rules| rows here, so the
    merchant join that follows cannot skew.
    """
    as_of = as_of_col(params.as_of)
    is_flag_type = upper_eq(F.col("case_type"), params.flag_case_type)
    assigned = is_flag_type & half_open_window(F.col("case_assigned_time"), as_of, params.window_months)
    closed = assigned & upper_eq(F.col("state"), params.closed_state)
    created = is_flag_type & half_open_window(F.col("time_created"), as_of, params.window_months)

    def any_(c):
        return F.max(F.coalesce(c, F.lit(False)).cast("int"))

    return (cases.select(*by, "profile_id", "rule_group",
                         assigned.alias("a"), closed.alias("c"), created.alias("d"))
            .groupBy(*by, "profile_id", "rule_group")
            .agg(any_(F.col("a")).alias("flag_assigned"), any_(F.col("c")).alias("flag_closed"),
                 any_(F.col("d")).alias("flag_created")))


def _precision_from(merchant_rows: DataFrame, flags: DataFrame, catalog: RuleCatalog,
                    by: Sequence[str] = (), hidden_reason: str = "hidden_account") -> DataFrame:
    """D6 from merchants and the flags of their cases, sorted by rule; no cap on its rows."""
    m = merchant_rows.select(
        "profile_id",
        (F.col("date_offboarded").isNotNull()
         & not_equal_keep_null(F.col("offboarding_reason"), hidden_reason)).alias("m_offboarded"),
        F.col("deactivation_reason").isNotNull().alias("m_deactivated"))
    # A merchant with no case carries no planning key and cannot be placed in a
    # unit; a case whose key is NULL is in the unit NULL.
    j = m.join(flags, "profile_id", "inner" if by else "left")
    rule = F.coalesce(F.col("rule_group"), F.lit(catalog.precision_else))
    one = F.lit(1)
    per_profile = j.groupBy(*by, rule.alias("rule_group"), "profile_id").agg(
        F.max(F.when(F.col("flag_assigned") == one, one).otherwise(0)).alias("f1"),
        F.max(F.when((F.col("flag_closed") == one) & F.col("m_offboarded"), one).otherwise(0)).alias("f2"),
        F.max(F.when((F.col("flag_created") == one) & F.col("m_deactivated"), one).otherwise(0)).alias("f3"),
    )
    per_rule = per_profile.groupBy(*by, "rule_group").agg(
        F.count_if((F.col("f1") == 1) & F.col("profile_id").isNotNull()).alias("flagged"),
        F.count_if((F.col("f2") == 1) & F.col("profile_id").isNotNull()).alias("offboarded"),
        F.count_if((F.col("f3") == 1) & F.col("profile_id").isNotNull()).alias("deactivated"),
    )
    out = per_rule.select(
        *by, "rule_group",
        F.col("flagged").cast("long").alias("profiles_flagged_by_risk_rules"),
        F.col("offboarded").cast("long").alias("profiles_flagged_and_offboarded"),
        F.col("deactivated").cast("long").alias("profiles_flagged_by_rule_and_deactivated_by_fraud"),
        pct_half_up(F.col("offboarded"), F.col("flagged")).alias("precision_l3m"),
    )
    return out.orderBy(*by, "rule_group")


def precision_report(precision: DataFrame, row_cap: int | None = None) -> DataFrame:
    """O2: the stand-alone report, sorted by rule, with a cap on its rows where one is asked for."""
    out = precision.orderBy("rule_group")
    return out.limit(row_cap) if row_cap else out


def rule_precision(requests: DataFrame, payments: DataFrame, merchants: DataFrame,
                   dd_case: DataFrame, case_state_change: DataFrame, params: PrecisionParams,
                   catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """D6 with the arguments of the source's join graph (requests, payments, merchants, cases).

    The request/payment spine only repeats merchant rows and every output is
    a distinct count, so neither table is read: this is
    ``rule_precision_pruned``.  ``request_payment_merchant_spine`` and
    ``spine_per_merchant`` are the joins themselves.
    """
    return rule_precision_pruned(merchants, dd_case, case_state_change, params, catalog)


def rule_precision_pruned(merchants: DataFrame, dd_case: DataFrame, case_state_change: DataFrame,
                          params: PrecisionParams, catalog: RuleCatalog = DEFAULT_CATALOG,
                          by: Sequence[str] = ()) -> DataFrame:
    """D6 starting from merchants: requests and payments cannot change a distinct count.

    Valid because the status filter rejects rows without a merchant, and a
    full outer join keeps every merchant row at least once.  ``by`` adds
    case-side grouping keys.

    Only cases that were created or assigned in the window can raise a flag;
    only their events are pivoted.  Rules whose cases are all outside it appear
    with zeros, from ids and labels alone.
    """
    as_of = as_of_col(params.as_of)
    merchant_rows = merchants.filter(merchant_filter(params))
    cases = window_cases(dd_case, case_state_change, F.add_months(as_of, -params.window_months), as_of, params.case_types, carry=by)
    flags = case_flags(cases.withColumn("rule_group", classify_exact(F.col("rule_triggered"), catalog)), params, by)
    present = present_rules(dd_case, case_state_change, params.case_types, catalog, by)
    zeros = present.withColumns({c: F.lit(0) for c in ("flag_assigned", "flag_closed", "flag_created")})
    return _precision_from(merchant_rows, flags.unionByName(zeros), catalog, by, params.hidden_reason)
