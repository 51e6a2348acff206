"""Case-side operators: rule classification windows, first case, review times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewcap.catalog import DEFAULT_CATALOG, RuleCatalog
from reviewcap.functions import boundary_diff, classify_contains
from reviewcap.params import ACQUIRING, PAYFAC_DD, LossParams, as_of_col
from reviewcap.sources.schemas import CASE_CARRIED


def loss_cases(dd_case: DataFrame, params: LossParams, catalog: RuleCatalog = DEFAULT_CATALOG,
               by: Sequence[str] = ()) -> DataFrame:
    """Closed cases of the loss case type created in the window, with their rule group.

    The window has a lower bound only (as in the source).  Filters are plain
    column predicates, so they reach the parquet scan before classification.
    """
    as_of = as_of_col(params.as_of)
    c = dd_case.filter(
        (F.col("time_created") >= F.add_months(as_of, -params.window_months))
        & (F.col("case_type") == params.case_type)
        & (F.col("state") == params.closed_state))
    return c.select(
        *by,
        classify_contains(F.col("metadata"), catalog).alias("rule_group"),
        F.col("id").alias("case_id"),
        F.col("reference_id").alias("profile_id"),
        F.col("time_created").alias("created_time"),
    )


def classify_contains_counts(dd_case: DataFrame, catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """Cases per contains-mode rule group over the whole case table."""
    return (dd_case.select(classify_contains(F.col("metadata"), catalog).alias("rule_group"))
            .groupBy("rule_group").agg(F.count(F.lit(1)).alias("cases")))


def first_case_per_profile_rule(dd_case: DataFrame, params: LossParams,
                                catalog: RuleCatalog = DEFAULT_CATALOG,
                                by: Sequence[str] = ()) -> DataFrame:
    """First case (in the window) per (rule group, profile): a grouped minimum.

    Partial aggregation runs map-side, so a profile with very many cases
    collapses to one row per rule before the shuffle.
    """
    return (loss_cases(dd_case, params, catalog, by)
            .groupBy(*by, "rule_group", "profile_id")
            .agg(F.min("created_time").alias("created_time")))


def _event_pivot(case_state_change: DataFrame) -> DataFrame:
    """One row per case id: first creation, assignment, close time and min assign actor."""
    ev, t = F.col("event"), F.col("time_created")
    return case_state_change.groupBy("case_id").agg(
        F.min(F.when(ev == "CASE_CREATION", t)).alias("case_created_time"),
        F.min(F.when(ev == "ASSIGN", t)).alias("case_assigned_time"),
        F.min(F.when(ev == "CLOSE", t)).alias("case_closed_time"),
        F.min(F.when(ev == "ASSIGN", F.col("actor"))).alias("assigned_actor"),
    )


def case_review_times(dd_case: DataFrame, case_state_change: DataFrame,
                      case_types: Sequence[str] = (ACQUIRING, PAYFAC_DD),
                      carry: Sequence[str] = ()) -> DataFrame:
    """Per case of the given types: its attributes plus the event-log pivot.

    The log is aggregated per case before the join (partial aggregation
    shrinks it map-side), then joined 1:1 to the filtered cases.  The final
    grouping by all case attributes keeps the source's semantics when a case
    id repeats; it reuses the join's case-id partitioning, so no extra shuffle.
    Catalyst prunes pivot columns a caller does not use.  ``carry`` adds
    further case columns (e.g. a team key) as grouping keys.
    """
    carried = [c for c in CASE_CARRIED if c in dd_case.columns] + [c for c in carry if c not in CASE_CARRIED]
    cases = dd_case.filter(F.col("case_type").isin(list(case_types))).select(
        F.col("id").alias("case_id"),
        F.col("reference_id").alias("profile_id"),
        *carried,
        "time_created", "case_type", "state",
        F.col("metadata").alias("rule_triggered"),
    )
    keys = ["case_id", "profile_id", *carried, "time_created", "case_type", "state", "rule_triggered"]
    return (_event_pivot(case_state_change).join(cases, "case_id")
            .groupBy(*keys)
            .agg(F.min("case_created_time").alias("case_created_time"),
                 F.min("case_assigned_time").alias("case_assigned_time"),
                 F.min("case_closed_time").alias("case_closed_time"),
                 F.min("assigned_actor").alias("assigned_actor")))


def case_turnaround(review_times: DataFrame) -> DataFrame:
    """Review times plus four boundary-counting differences (minutes / hours)."""
    cr, asg, cl = F.col("case_created_time"), F.col("case_assigned_time"), F.col("case_closed_time")
    return review_times.select(
        "*",
        boundary_diff("MINUTE", cr, asg).alias("minutes_created_to_assignment"),
        boundary_diff("HOUR", cr, asg).alias("hours_created_to_assigned"),
        boundary_diff("MINUTE", asg, cl).alias("minutes_assigned_to_reviewed"),
        boundary_diff("HOUR", cr, cl).alias("hours_created_to_reviewed"),
    )
