"""PLAN, part 2: greedy review-type assignment under a weekly hours budget.

Per planning unit, rules are visited by descending priority score (ties by
rule name).  Every unlocked rule starts at Light; a rule whose ceiling (its
current type) is above Light is upgraded if the unit's weekly hours with the
upgrade stay within budget, otherwise it is skipped and the walk goes on.
Standard and Deep cost the same minutes (the rule's own handling time), so
an accepted rule ends at its current type.  Locked rules keep their lock.

Acceptance depends on earlier acceptances, so no window frame can express
it.  Each unit's rules (bounded by the rule catalog, checked in-plan) are
folded with ``aggregate`` over ``array_sort(collect_list(...))`` - JVM-side,
one row per unit - and exploded back to rule rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewcap.functions import round2_half_even
from reviewcap.operators.scoring import budget_col, drop_unit, unit_keys, weekly_hours_with_overhead
from reviewcap.params import REVIEW_TYPES, PlanParams

LIGHT = REVIEW_TYPES[0]


def review_level(t: Column) -> Column:
    """Light=0, Standard=1, Deep=2 (NULL for anything else)."""
    out = None
    for i, name in enumerate(REVIEW_TYPES):
        out = F.when(t == name, F.lit(i)) if out is None else out.when(t == name, F.lit(i))
    return out


def known_type(t: Column) -> Column:
    """``t``, or an error for a review type that is not one of the three (NULL passes)."""
    return F.when(t.isNull() | t.isin(*REVIEW_TYPES), t).otherwise(
        F.raise_error(F.concat(F.lit("unknown review type: "), t)).cast("string"))


def lock_type(rule_name: Column, params: PlanParams) -> Column:
    """The locked review type of a rule, or NULL (a literal map: locks are parameters)."""
    if not params.locks:
        return F.lit(None).cast("string")
    kv = [F.lit(x) for pair in params.locks for x in pair]
    return F.try_element_at(F.create_map(*kv), rule_name)


def minutes_for(t: Column, cases: Column, aht: Column, params: PlanParams) -> Column:
    """Monthly minutes of a rule at review type ``t`` (Light is a fixed time per case)."""
    per_case = F.when(t == LIGHT, F.lit(params.light_minutes)).otherwise(aht)
    return cases.cast("long") * per_case.cast("long")


def review_assignment(scored: DataFrame, params: PlanParams, units: Sequence[str] = ()) -> DataFrame:
    """Proposed review type and time per rule, per unit.

    Input: rule rows with ``rule_name, current_review_type, avg_cases_per_month,
    avg_handling_time_minutes, priority_score`` (+ unit keys, optional
    ``budget_weekly_hours`` per unit).  Output: the input columns plus
    ``locked, proposed_review_type, proposed_time_minutes, proposed_time_hours``.
    """
    df, keys = unit_keys(scored, units)
    df = df.withColumn("current_review_type", known_type(F.col("current_review_type")))
    cases, aht = F.col("avg_cases_per_month"), F.col("avg_handling_time_minutes")
    lock = lock_type(F.col("rule_name"), params)
    init_type = F.coalesce(lock, F.lit(LIGHT))
    candidate = lock.isNull() & (F.coalesce(review_level(F.col("current_review_type")), F.lit(0)) > 0)
    delta = cases.cast("long") * (aht.cast("long") - F.lit(params.light_minutes))
    df = df.withColumns({
        "_init_minutes": minutes_for(init_type, cases, aht, params),
        "_candidate": candidate,
        "_delta": F.when(candidate, delta).otherwise(F.lit(0).cast("long")),
        "_lock": lock,
    })
    payload = [c for c in df.columns if c not in keys]
    # A rule without a score is visited last, as the source sorts missing scores last.
    item = F.struct(F.col("priority_score").isNull().alias("_no_score"),
                    (-F.col("priority_score")).alias("_neg_score"), F.col("rule_name").alias("_rule"),
                    *[F.col(c) for c in payload])
    per_unit = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.sum("_init_minutes").alias("_base"),
        F.min(budget_col(df, params)).alias("_budget"),
    )
    budget = F.col("_budget")

    def step(acc: Column, x: Column) -> Column:
        trial = acc["tot"] + x["_delta"]
        ok = x["_candidate"] & (weekly_hours_with_overhead(trial, params) <= budget)
        return F.struct(F.when(ok, trial).otherwise(acc["tot"]).alias("tot"),
                        F.array_append(acc["ok"], ok).alias("ok"))

    init = F.struct(F.col("_base").cast("long").alias("tot"), F.array().cast("array<boolean>").alias("ok"))
    folded = per_unit.select(*keys, "_items", F.aggregate("_items", init, step)["ok"].alias("_ok"))
    rows = folded.select(*keys, F.inline(F.transform(
        "_items", lambda x, i: F.struct(x.alias("r"), F.element_at(F.col("_ok"), i + 1).alias("_accepted")))))
    rows = rows.select(*keys, "r.*", "_accepted").drop("_no_score", "_neg_score", "_rule")
    proposed = (F.when(F.col("_lock").isNotNull(), F.col("_lock"))
                .when(F.col("_accepted"), F.col("current_review_type"))
                .otherwise(F.lit(LIGHT)))
    mins = minutes_for(F.col("proposed_review_type"), cases, aht, params)
    out = (rows.withColumn("locked", F.col("_lock").isNotNull())
           .withColumn("proposed_review_type", proposed)
           .withColumn("proposed_time_minutes", mins)
           .withColumn("proposed_time_hours", round2_half_even(F.col("proposed_time_minutes").cast("double")
                                                               / F.lit(60.0)))
           .drop("_init_minutes", "_candidate", "_delta", "_lock", "_accepted"))
    return drop_unit(out) if not units else out


REPORT_COLS = ("rule_name", "current_review_type", "priority_score", "proposed_review_type",
               "avg_cases_per_month", "avg_handling_time_minutes", "proposed_time_hours")


def proposed_state_report(assigned: DataFrame, units: Sequence[str] = ()) -> DataFrame:
    """The seven report columns, sorted by rule name (binary order)."""
    return assigned.select(*units, *REPORT_COLS).orderBy(*units, "rule_name")


def assignment_summary(assigned: DataFrame, params: PlanParams, units: Sequence[str] = ()) -> DataFrame:
    """D20 per unit: final minutes and weekly hours (with overhead), budget, feasibility."""
    df, keys = unit_keys(assigned, units)
    g = df.groupBy(*keys).agg(
        F.sum("proposed_time_minutes").alias("final_total_minutes"),
        F.min(budget_col(df, params)).alias("budget_weekly_hours"),
        F.count_if(F.col("proposed_review_type") == LIGHT).alias("rules_at_light"),
        F.count(F.lit(1)).alias("rules"),
    )
    hours = weekly_hours_with_overhead(F.col("final_total_minutes"), params)
    out = g.select(*keys, F.col("final_total_minutes").cast("long").alias("final_total_minutes"),
                   hours.alias("final_weekly_hours"), "budget_weekly_hours",
                   (hours <= F.col("budget_weekly_hours")).alias("feasible"),
                   F.col("rules_at_light").cast("long").alias("rules_at_light"),
                   F.col("rules").cast("long").alias("rules"))
    return drop_unit(out)


def capacity_comparison(assigned: DataFrame, params: PlanParams, units: Sequence[str] = ()) -> DataFrame:
    """Current vs proposed weekly hours per unit, in one aggregation of the assigned rules.

    The assigned rows still carry each rule's cases and handling time, so the
    current state (D9, without the monthly overhead, and with it for a
    like-for-like comparison) and the proposal (D20) come from the same pass:
    no join of separately computed tables, nothing recomputed.
    """
    df, keys = unit_keys(assigned, units)
    cur_minutes = F.col("avg_cases_per_month").cast("long") * F.col("avg_handling_time_minutes").cast("long")
    cents = F.rint(cur_minutes.cast("double") / F.lit(60.0) * F.lit(100.0)).cast("long")
    g = df.groupBy(*keys).agg(
        F.sum(cents).alias("_cents"), F.sum(cur_minutes).alias("_cur_minutes"),
        F.sum("proposed_time_minutes").alias("_final_minutes"),
        F.min(budget_col(df, params)).alias("budget_weekly_hours"))
    monthly = F.col("_cents").cast("double") / F.lit(100.0)
    current = (monthly * F.lit(float(params.months_per_year)) / F.lit(float(params.weeks_per_year))
               + F.lit(float(params.weekly_fixed_hours)))
    current_oh = weekly_hours_with_overhead(F.col("_cur_minutes"), params)
    final = weekly_hours_with_overhead(F.col("_final_minutes"), params)
    out = g.select(
        *keys,
        current.alias("current_weekly_hours"),
        current_oh.alias("current_weekly_hours_with_overhead"),
        final.alias("final_weekly_hours"),
        "budget_weekly_hours",
        (final <= F.col("budget_weekly_hours")).alias("feasible"),
        (current_oh - final).alias("hours_saved_weekly"),
        (final - F.col("budget_weekly_hours")).alias("hours_over_budget"),
    )
    return drop_unit(out)
