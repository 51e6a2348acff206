"""PLAN, part 1: current workload, attached loss, priority scores.

Every function works per planning unit (``units`` columns); with no unit
columns the whole input is one unit, as in the source analysis.  Scores are
computed inside each unit's collected row, so scoring and the assignment
fold share one exchange on the unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewcap.functions import round2_half_even
from reviewcap.params import LossParams, PlanParams

UNIT = "_unit"
DEALT_ROWS = 1 << 16  # rule rows that a partition holds on average when they are dealt out by unit


def unit_keys(df: DataFrame, units: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Planning-unit key columns; a constant key when there are none."""
    if units:
        return df, list(units)
    return df.withColumn(UNIT, F.lit(0)), [UNIT]


def drop_unit(df: DataFrame) -> DataFrame:
    return df.drop(UNIT) if UNIT in df.columns else df


def dealt_by_unit(rows: DataFrame, units: Sequence[str], rules: int = 1) -> DataFrame:
    """``rows`` (of so many ``rules`` each) dealt out by unit, about ``DEALT_ROWS`` rules to a partition.

    Scoring and assignment collect each unit's rules: on rows that are dealt
    out they need no other exchange, nothing is collected before it, and what
    a task holds does not grow with the table.  The rows are counted first.
    """
    if not units:
        return rows
    parts = max(1, -(-rows.count() * rules // DEALT_ROWS))
    return rows.repartition(parts, *[F.col(u) for u in units])


def budget_col(df: DataFrame, params: PlanParams) -> Column:
    if "budget_weekly_hours" in df.columns:
        return F.col("budget_weekly_hours").cast("double")
    return F.lit(float(params.budget_weekly_hours))


def weekly_hours_with_overhead(total_minutes: Column, params: PlanParams) -> Column:
    """D16 ``((minutes / 60) + 24.8) * (12 / 52) + 20``, operation order kept."""
    return ((total_minutes.cast("double") / F.lit(60.0) + F.lit(float(params.monthly_overhead_hours)))
            * F.lit(params.months_per_year / params.weeks_per_year)
            + F.lit(float(params.weekly_fixed_hours)))


def current_hours_per_month(df: DataFrame) -> Column:
    """D7 ``round(cases * aht / 60, 2)``."""
    return round2_half_even(
        (F.col("avg_cases_per_month").cast("long") * F.col("avg_handling_time_minutes").cast("long"))
        .cast("double") / F.lit(60.0))


def current_state(rule_inputs: DataFrame, params: PlanParams, units: Sequence[str] = ()) -> DataFrame:
    """D9 per unit: current monthly and weekly hours, target, gap and gap %.

    Monthly hours add the per-rule values already rounded to cents, summed
    as exact cents.  ``current_weekly_hours`` omits the 24.8 h overhead (as
    the source's current-state cell does); ``..._with_overhead`` applies the
    assignment formula to the same minutes, for like-for-like comparison.
    """
    df, keys = unit_keys(rule_inputs, units)
    minutes_d = (F.col("avg_cases_per_month").cast("long") * F.col("avg_handling_time_minutes").cast("long")
                 ).cast("double")
    cents = F.rint(minutes_d / F.lit(60.0) * F.lit(100.0)).cast("long")
    minutes = F.col("avg_cases_per_month").cast("long") * F.col("avg_handling_time_minutes").cast("long")
    g = df.groupBy(*keys).agg(
        F.sum(cents).alias("_cents"), F.sum(minutes).alias("current_total_minutes"),
        F.min(budget_col(df, params)).alias("target_weekly_hours"))
    monthly = F.col("_cents").cast("double") / F.lit(100.0)
    weekly = (monthly * F.lit(float(params.months_per_year)) / F.lit(float(params.weeks_per_year))
              + F.lit(float(params.weekly_fixed_hours)))
    out = g.select(
        *keys,
        monthly.alias("current_monthly_hours"),
        weekly.alias("current_weekly_hours"),
        "target_weekly_hours",
        (weekly - F.col("target_weekly_hours")).alias("reduction_needed_hours"),
        ((weekly - F.col("target_weekly_hours")) / weekly * F.lit(100.0)).alias("reduction_needed_pct"),
        F.col("current_total_minutes").cast("long").alias("current_total_minutes"),
        weekly_hours_with_overhead(F.col("current_total_minutes"), params)
        .alias("current_weekly_hours_with_overhead"),
    )
    return drop_unit(out)


def rounded_rule_loss(loss: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rule_group, avg) with the average rounded to 2 places, as the display does."""
    return loss.select(*keys, "rule_group", round2_half_even(F.col("avg_fraud_per_problematic_merchant"))
                       .alias("_avg_loss"))


def attach_loss(rule_inputs: DataFrame, loss: DataFrame, loss_params: LossParams,
                keys: Sequence[str] = ()) -> DataFrame:
    """Per rule, the average loss per problematic merchant (0.0 when absent), also per month.

    The months are those of the window LOSS was computed with.  ``keys`` are
    planning-unit columns present on both sides when LOSS was computed per
    unit (``rule_loss(..., by=keys)``); a NULL key is a unit like others.  Without
    ``keys`` LOSS has one row per rule of the catalog and is broadcast, so that
    the inputs stay where they are (a join by rule name would deal them out by a
    few names); with ``keys`` the planner, which measures both sides, decides (AQE).
    """
    lk = rounded_rule_loss(loss, keys).withColumnsRenamed(
        {"rule_group": "_rule_group", **{k: f"_key_{k}" for k in keys}})
    cond = rule_inputs["rule_name"] == lk["_rule_group"]
    for k in keys:
        cond = cond & rule_inputs[k].eqNullSafe(lk[f"_key_{k}"])
    j = rule_inputs.join(lk if keys else F.broadcast(lk), cond, "left").drop("_rule_group", *[f"_key_{k}" for k in keys])
    avg = F.coalesce(F.col("_avg_loss"), F.lit(0.0))
    return j.withColumns({
        "avg_fraud_volume_per_problematic_merchant": avg,
        "monthly_avg_fraud_volume_per_problematic_merchant": avg / F.lit(float(loss_params.window_months)),
    }).drop("_avg_loss")


def unplanned_loss_rules(rule_inputs: DataFrame, loss: DataFrame) -> DataFrame:
    """Loss rule groups that no planning input covers (their loss is never planned)."""
    names = rule_inputs.select(F.col("rule_name").alias("rule_group")).distinct()
    return loss.join(names, "rule_group", "left_anti")


def priority_scores(with_loss: DataFrame, params: PlanParams, precision_col: str | None = None,
                    units: Sequence[str] = ()) -> DataFrame:
    """Loss, precision and volume scores and their weighted, rounded sum.

    ``precision_col`` is ``per_case_precision`` (D12) or ``rule_precision_l3m``
    (D13, rounded to 2 places first); the default follows the source, whose
    second score replaces the first before planning.

    The per-unit maxima (J9) are taken inside each unit's row: the unit's
    rules (bounded by the catalog) are collected once, ``array_max`` gives the
    maxima and ``transform`` scores every rule, then ``inline`` returns rows.
    One aggregation per unit - the same hash exchange the assignment fold
    uses, or none on rows of ``dealt_by_unit`` - with no window (never a single-partition one) and no subquery
    that would recompute the upstream LOSS.
    """
    precision_col = precision_col or params.precision_col
    df, keys = unit_keys(with_loss, units)
    payload = [c for c in df.columns if c not in keys]

    def monthly(x: Column) -> Column:
        return x["monthly_avg_fraud_volume_per_problematic_merchant"]

    def effort(x: Column) -> Column:
        return x["avg_cases_per_month"].cast("long") * x["avg_handling_time_minutes"].cast("long")

    g = df.groupBy(*keys).agg(F.collect_list(F.struct(*payload)).alias("_rules"))
    g = g.withColumns({"_max_loss": F.array_max(F.transform("_rules", monthly)),
                       "_max_effort": F.array_max(F.transform("_rules", effort))})
    wl, wp, wv = (float(w) for w in params.weights)

    def score(x: Column) -> Column:
        loss_score = F.when(F.col("_max_loss") > 0, F.least(
            (monthly(x) / F.col("_max_loss")) * F.lit(100.0), F.lit(100.0))).otherwise(F.lit(0.0))
        prec = x[precision_col].cast("double")
        if precision_col == "rule_precision_l3m":
            prec = round2_half_even(prec)
        volume = F.when(F.col("_max_effort") > 0, (effort(x).cast("double") / F.col("_max_effort").cast("double"))
                        * F.lit(100.0)).otherwise(F.lit(0.0))
        total = round2_half_even(loss_score * F.lit(wl) + prec * F.lit(wp) + volume * F.lit(wv))
        return (x.withField("loss_score", loss_score).withField("precision_score", prec)
                .withField("volume_score", volume).withField("priority_score", total))

    out = g.select(*keys, F.inline(F.transform("_rules", score)))
    return drop_unit(out) if not units else out


def prioritisation_report(scored: DataFrame, params: PlanParams, precision_col: str | None = None,
                          units: Sequence[str] = ()) -> DataFrame:
    """Rules by descending priority (no score last, ties by name) with the inputs behind the score."""
    precision_col = precision_col or params.precision_col
    return scored.select(*units, "rule_name", "monthly_avg_fraud_volume_per_problematic_merchant",
                         "avg_cases_per_month", "avg_handling_time_minutes", precision_col,
                         "current_review_type", "priority_score").orderBy(
        *units, F.desc_nulls_last("priority_score"), "rule_name")
