"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the fixture views over the driver tables (or results Spark
derives from them), so its work grows with the scale factor.  Some store a
result when they are built, as several branches of their plan read it
(``post_case_payments``) or as storing is what they show
(``review_assignment_from_table``, ``derived_rule_inputs_from_months``,
``rule_loss_published``).  Keys match
``oracle_sql()``; every computed column is aliased identically on both sides.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewcap.operators import cases as C
from reviewcap.operators import derive as D
from reviewcap.operators import facts as X
from reviewcap.operators import loss as L
from reviewcap.operators import precision as P
from reviewcap.operators import assignment as A
from reviewcap.operators import scoring as S
from reviewcap.params import DEFAULT_PLAN, FIXTURE_LOSS, FIXTURE_PRECISION
from reviewcap.session import ensure_checkpoint_dir
from reviewcap.sources import (fixture_customers, fixture_tables, load_rule_inputs, published_rule_inputs,
                               unit_portfolios)
from reviewcap.sources.rule_inputs import PUBLISHED_RULE_INPUTS
from reviewcap.sources.sinks import publish_result, read_published

EMPTY_AS_OF = dt.date(2031, 1, 1)  # after every case of the given tables
PUBLISHED_ROW_CAP = 500  # the stand-alone precision report shows this many rules at most

Query = Callable[[SparkSession, str], DataFrame]


def portable(df: DataFrame, text: tuple[str, ...] = (), double: tuple[str, ...] = ()) -> DataFrame:
    """Cast NULL-bearing dates / flags / ids to ISO text and nullable counts to double.

    Only the registered outputs do this (the oracle casts the same columns), so
    both engines' results hash alike however they are converted; the operators
    keep their natural types.
    """
    return df.withColumns({**{c: F.col(c).cast("string") for c in text},
                           **{c: F.col(c).cast("double") for c in double}})


def classify_contains(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_contains_counts(fixture_tables(spark, sf).dd_case)


def classify_exact(spark: SparkSession, sf: str) -> DataFrame:
    from reviewcap.functions import classify_exact as cx
    t = fixture_tables(spark, sf)
    return (t.dd_case.select(cx(F.col("metadata")).alias("rule_group"))
            .groupBy("rule_group").agg(F.count(F.lit(1)).alias("cases")))


def first_case_per_profile_rule(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_case_per_profile_rule(fixture_tables(spark, sf).dd_case, FIXTURE_LOSS)


def post_case_payments(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    first = C.first_case_per_profile_rule(t.dd_case, FIXTURE_LOSS)
    out = L.post_case_payments(first, t.merchants, t.payments, FIXTURE_LOSS)
    return portable(out, text=("card_attempt_id", "fraud_flag", "date_offboarded"),
                    double=("attempted_gbp_amount_gross", "chargeback_amount_gbp"))


def rule_loss(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return L.rule_loss(t.dd_case, t.merchants, t.payments, FIXTURE_LOSS)


def rule_loss_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return L.rule_loss_summary(t.dd_case, t.merchants, t.payments, FIXTURE_LOSS)


def rule_loss_display(spark: SparkSession, sf: str) -> DataFrame:
    return L.rule_loss_display(rule_loss(spark, sf))


def case_review_times(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return C.case_review_times(t.dd_case, t.case_state_change, FIXTURE_PRECISION.case_types)


TURNAROUND = ("minutes_created_to_assignment", "hours_created_to_assigned", "minutes_assigned_to_reviewed",
              "hours_created_to_reviewed")


def case_turnaround(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return portable(P.payfac_dd_cases(t.dd_case, t.case_state_change, FIXTURE_PRECISION), double=TURNAROUND)


def request_payment_merchant_spine(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return portable(P.spine_per_merchant(t.requests, t.payments, t.merchants, FIXTURE_PRECISION),
                    text=("date_offboarded",))


def rule_precision(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return P.precision_report(P.rule_precision(t.requests, t.payments, t.merchants, t.dd_case, t.case_state_change,
                                               FIXTURE_PRECISION), PUBLISHED_ROW_CAP)


def rule_precision_pruned(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return P.rule_precision_pruned(t.merchants, t.dd_case, t.case_state_change, FIXTURE_PRECISION)


def rule_precision_by_team(spark: SparkSession, sf: str) -> DataFrame:
    """PRECISION per team; cases without a team are the team NULL."""
    t = fixture_tables(spark, sf)
    return P.rule_precision_pruned(t.merchants, t.dd_case, t.case_state_change, FIXTURE_PRECISION, by=("team",))


def rule_loss_by_team(spark: SparkSession, sf: str) -> DataFrame:
    """LOSS per team; cases without a team are the team NULL."""
    t = fixture_tables(spark, sf)
    return L.rule_loss(t.dd_case, t.merchants, t.payments, FIXTURE_LOSS, by=("team",))


# --- PLAN: one planning unit per customer (FIXTURES.md "Many units") --------
UNITS = ("unit",)


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return unit_portfolios(fixture_customers(spark, sf))


def _dealt_units(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of each unit in one partition: the customers are dealt out, before each becomes many rows."""
    customers = S.dealt_by_unit(fixture_customers(spark, sf), ("c_custkey",), len(PUBLISHED_RULE_INPUTS))
    return unit_portfolios(customers)


def _scored_units(spark: SparkSession, sf: str, precision_col: str) -> DataFrame:
    with_loss = S.attach_loss(_dealt_units(spark, sf), rule_loss(spark, sf), FIXTURE_LOSS)
    return S.priority_scores(with_loss, DEFAULT_PLAN, precision_col, UNITS)


def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.current_state(_units(spark, sf), DEFAULT_PLAN, UNITS)


def attach_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = S.attach_loss(_units(spark, sf), rule_loss(spark, sf), FIXTURE_LOSS)
    return out.select("unit", "rule_name", "avg_fraud_volume_per_problematic_merchant",
                      "monthly_avg_fraud_volume_per_problematic_merchant")


def _priority(precision_col: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _scored_units(spark, sf, precision_col).select(
            "unit", "rule_name", "loss_score", "precision_score", "volume_score", "priority_score")
    return run


def _prioritisation(precision_col: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.prioritisation_report(_scored_units(spark, sf, precision_col), DEFAULT_PLAN, precision_col, UNITS)
    return run


def review_assignment_null_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Plans in which a fifth of the rules have no precision, hence no score: they are visited last."""
    inputs = _dealt_units(spark, sf).withColumn("rule_precision_l3m", F.when(
        (F.col("unit") + F.col("pos")) % 5 != 0, F.col("rule_precision_l3m")))
    with_loss = S.attach_loss(inputs, rule_loss(spark, sf), FIXTURE_LOSS)
    scored = S.priority_scores(with_loss, DEFAULT_PLAN, "rule_precision_l3m", UNITS)
    plan = A.review_assignment(scored, DEFAULT_PLAN, UNITS)
    return portable(plan.select("unit", "rule_name", "priority_score", "proposed_review_type"), text=("priority_score",))


def review_assignment_from_table(spark: SparkSession, sf: str) -> DataFrame:
    """Plans per unit from a stored parameter table, read and validated."""
    table = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reviewcap-stored/parameters-{uuid.uuid4().hex}"
    _dealt_units(spark, sf).write.parquet(table)
    inputs = load_rule_inputs(spark, table, UNITS)
    with_loss = S.attach_loss(inputs, rule_loss(spark, sf), FIXTURE_LOSS)
    plan = A.review_assignment(S.priority_scores(with_loss, DEFAULT_PLAN, units=UNITS), DEFAULT_PLAN, UNITS)
    return plan.select(
        "unit", "rule_name", "current_review_type", "priority_score", "proposed_review_type",
        "avg_cases_per_month", "avg_handling_time_minutes", "proposed_time_minutes", "proposed_time_hours")


def review_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The source's single-team plan: published inputs, loss measured on the tables."""
    with_loss = S.attach_loss(published_rule_inputs(spark), rule_loss(spark, sf), FIXTURE_LOSS)
    scored = S.priority_scores(with_loss, DEFAULT_PLAN)
    return A.proposed_state_report(A.review_assignment(scored, DEFAULT_PLAN))


def _assigned_units(spark: SparkSession, sf: str) -> DataFrame:
    return A.review_assignment(_scored_units(spark, sf, "rule_precision_l3m"), DEFAULT_PLAN, UNITS)


def review_assignment_by_unit(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned_units(spark, sf).select(
        "unit", "rule_name", "current_review_type", "priority_score", "proposed_review_type",
        "avg_cases_per_month", "avg_handling_time_minutes", "proposed_time_minutes", "proposed_time_hours")


def capacity_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return A.capacity_comparison(_assigned_units(spark, sf), DEFAULT_PLAN, UNITS)


# --- Derived inputs (X1-X5) --------------------------------------------------
TREND_DATES = tuple(D.month_starts(FIXTURE_PRECISION.as_of, 6))


def derived_rule_inputs(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return D.derived_rule_inputs(spark, t.dd_case, t.case_state_change, t.merchants, FIXTURE_LOSS,
                                 FIXTURE_PRECISION)


def review_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily facts of both windows, per profile and rule."""
    t = fixture_tables(spark, sf)
    start, end = D.facts_span(FIXTURE_LOSS, FIXTURE_PRECISION)
    return portable(X.review_facts(t.dd_case, t.case_state_change, start, end, FIXTURE_LOSS, FIXTURE_PRECISION), text=("day",))


def _fact_months(spark: SparkSession, sf: str) -> str:
    """A store of months of facts, the last two added to the earlier ones one by one."""
    t = fixture_tables(spark, sf)
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reviewcap-stored/facts-{uuid.uuid4().hex}"
    cuts = [D.add_months(FIXTURE_LOSS.as_of, -FIXTURE_LOSS.window_months), *TREND_DATES[-2:], FIXTURE_LOSS.as_of]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            X.write_months(X.review_facts(t.dd_case, t.case_state_change, F.lit(start), F.lit(end), FIXTURE_LOSS, FIXTURE_PRECISION), store)
    return store


def derived_rule_inputs_from_months(spark: SparkSession, sf: str) -> DataFrame:
    """X1-X4 from stored months of facts."""
    start = D.add_months(FIXTURE_LOSS.as_of, -FIXTURE_LOSS.window_months)
    facts = X.read_months(spark, _fact_months(spark, sf), start, FIXTURE_LOSS.as_of)
    return D.rule_inputs_from_facts(spark, facts, fixture_tables(spark, sf).merchants, FIXTURE_LOSS, FIXTURE_PRECISION)


def rule_loss_summary_empty_window(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a loss window that no case lies in: one row of zeros."""
    t = fixture_tables(spark, sf)
    return L.rule_loss_summary(t.dd_case, t.merchants, t.payments, FIXTURE_LOSS.with_(as_of=EMPTY_AS_OF))


def rule_loss_published(spark: SparkSession, sf: str) -> DataFrame:
    """LOSS published twice as versions of a result and read back by its pointer: the later version alone."""
    t = fixture_tables(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reviewcap-stored/published-{uuid.uuid4().hex}"
    for as_of in (TREND_DATES[0], FIXTURE_LOSS.as_of):
        publish_result(L.rule_loss(t.dd_case, t.merchants, t.payments, FIXTURE_LOSS.with_(as_of=as_of)), folder)
    return read_published(spark, folder)


def derived_review_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """End to end with no typed-in numbers except current review types (default Standard)."""
    inputs = D.with_current_types(derived_rule_inputs(spark, sf), published_rule_inputs(spark))
    with_loss = S.attach_loss(inputs, rule_loss(spark, sf), FIXTURE_LOSS)
    scored = S.priority_scores(with_loss, DEFAULT_PLAN)
    return A.proposed_state_report(A.review_assignment(scored, DEFAULT_PLAN))


def rule_precision_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return portable(D.rule_precision_trend(t.merchants, t.dd_case, t.case_state_change, TREND_DATES,
                                           FIXTURE_PRECISION), text=("as_of",))


def rule_loss_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = fixture_tables(spark, sf)
    return portable(D.rule_loss_trend(t.dd_case, t.merchants, t.payments, TREND_DATES, FIXTURE_LOSS),
                    text=("as_of",))


QUERIES: dict[str, Query] = {
    "classify_contains": classify_contains,
    "classify_exact": classify_exact,
    "first_case_per_profile_rule": first_case_per_profile_rule,
    "post_case_payments": post_case_payments,
    "rule_loss": rule_loss,
    "rule_loss_summary": rule_loss_summary,
    "rule_loss_display": rule_loss_display,
    "case_review_times": case_review_times,
    "case_turnaround": case_turnaround,
    "request_payment_merchant_spine": request_payment_merchant_spine,
    "rule_precision": rule_precision,
    "rule_precision_pruned": rule_precision_pruned,
    "rule_precision_by_team": rule_precision_by_team,
    "rule_loss_by_team": rule_loss_by_team,
    "current_state": current_state,
    "attach_loss": attach_loss,
    "priority_case": _priority("per_case_precision"),
    "priority_l3m": _priority("rule_precision_l3m"),
    "review_assignment": review_assignment,
    "review_assignment_by_unit": review_assignment_by_unit,
    "prioritisation_report_case": _prioritisation("per_case_precision"),
    "prioritisation_report_l3m": _prioritisation("rule_precision_l3m"),
    "review_assignment_null_precision": review_assignment_null_precision,
    "review_assignment_from_table": review_assignment_from_table,
    "capacity_comparison": capacity_comparison,
    "review_facts": review_facts,
    "derived_rule_inputs": derived_rule_inputs,
    "derived_rule_inputs_from_months": derived_rule_inputs_from_months,
    "rule_loss_summary_empty_window": rule_loss_summary_empty_window,
    "rule_loss_published": rule_loss_published,
    "derived_review_assignment": derived_review_assignment,
    "rule_precision_trend": rule_precision_trend,
    "rule_loss_trend": rule_loss_trend,
}


def oracle_queries() -> dict[str, str]:
    from reviewcap.plans import oracle as O
    return {
        "classify_contains": O.classify_contains_sql(),
        "classify_exact": O.classify_exact_sql(),
        "first_case_per_profile_rule": O.first_case_sql(),
        "post_case_payments": O.post_case_payments_sql(),
        "rule_loss": O.rule_loss_sql(),
        "rule_loss_summary": O.rule_loss_summary_sql(),
        "rule_loss_display": O.rule_loss_display_sql(),
        "case_review_times": O.case_review_times_sql(),
        "case_turnaround": O.case_turnaround_sql(),
        "request_payment_merchant_spine": O.spine_sql(),
        "rule_precision": O.rule_precision_sql(),
        "rule_precision_pruned": O.rule_precision_sql(),
        "rule_precision_by_team": O.rule_precision_by_team_sql(),
        "rule_loss_by_team": O.rule_loss_by_team_sql(),
        "current_state": O.current_state_sql(),
        "attach_loss": O.attach_loss_sql(),
        "priority_case": O.priority_sql("per_case_precision"),
        "priority_l3m": O.priority_sql("rule_precision_l3m"),
        "review_assignment": O.review_assignment_sql(),
        "review_assignment_by_unit": O.review_assignment_by_unit_sql(),
        "prioritisation_report_case": O.prioritisation_report_sql("per_case_precision"),
        "prioritisation_report_l3m": O.prioritisation_report_sql("rule_precision_l3m"),
        "review_assignment_null_precision": O.review_assignment_null_precision_sql(),
        "review_assignment_from_table": O.review_assignment_by_unit_sql(),
        "capacity_comparison": O.capacity_comparison_sql(),
        "review_facts": O.review_facts_sql(),
        "derived_rule_inputs": O.derived_rule_inputs_sql(),
        "derived_rule_inputs_from_months": O.derived_rule_inputs_sql(),
        "rule_loss_summary_empty_window": O.rule_loss_summary_sql(f"DATE '{EMPTY_AS_OF.isoformat()}'"),
        "rule_loss_published": O.rule_loss_sql(),
        "derived_review_assignment": O.derived_review_assignment_sql(),
        "rule_precision_trend": O.rule_precision_trend_sql(TREND_DATES),
        "rule_loss_trend": O.rule_loss_trend_sql(TREND_DATES),
    }
