"""Candidate cases of a time window, and daily facts that merge over any window.

PRECISION and the derived inputs look at cases that something happened to in a
window: created, first assigned or first closed in it.  ``window_cases`` finds
their ids from scans bounded by the window and pivots the events of these
cases only.  ``review_facts`` counts what happened per (day, profile, rule):
counts and sums, so the facts of days add up to those of any window, and a
further month adds its own rows and changes none (``write_months``,
``read_months``: one folder a month, replaced as a whole).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewcap.catalog import DEFAULT_CATALOG, RuleCatalog
from reviewcap.functions import boundary_diff, classify_contains, classify_exact, upper_eq
from reviewcap.params import LossParams, PrecisionParams
from reviewcap.sources.schemas import CASE_CARRIED

FACTS = ("cases", "timed_cases", "minutes", "reviewed", "created", "assigned", "assigned_closed")


def _between(t: str, start: Column, end: Column) -> Column:
    return (F.col(t) >= start) & (F.col(t) < end)


def window_cases(dd_case: DataFrame, case_state_change: DataFrame, start: Column, end: Column,
                 case_types: Sequence[str], carry: Sequence[str] = (), closes: bool = False,
                 counted: bool = False) -> DataFrame:
    """case_id, profile_id, time_created, case_type, state, rule_triggered, case_assigned_time (and, with
    ``closes``, case_closed_time) of the cases with an event that were created, or have an assignment (or
    close), in the window.

    Times are the first of the whole history.  A case table that repeats a row
    repeats it here, unless the rows are to be ``counted``: then equal rows are
    one, as in ``case_review_times``.
    What has to be dealt out by case is what the window holds: of the other
    events only those of its cases are kept, against the (small) list of their
    ids, which Spark broadcasts where it is small and else joins by case id.
    """
    carried = [c for c in (*(CASE_CARRIED if counted else ()), *carry) if c in dd_case.columns]
    cases = dd_case.filter(F.col("case_type").isin(list(case_types))).select(
        F.col("id").alias("case_id"), F.col("reference_id").alias("profile_id"), *dict.fromkeys(carried),
        "time_created", "case_type", "state", F.col("metadata").alias("rule_triggered"))
    marks = ["ASSIGN", "CLOSE"] if closes else ["ASSIGN"]
    happened = case_state_change.filter(F.col("event").isin(marks) & _between("time_created", start, end)).select("case_id")
    ids = happened.unionByName(cases.filter(_between("time_created", start, end)).select("case_id")).distinct()
    events = case_state_change.join(ids, "case_id", "left_semi")
    first = {"ASSIGN": "case_assigned_time", "CLOSE": "case_closed_time"}
    pivot = events.groupBy("case_id").agg(*[F.min(F.when(F.col("event") == m, F.col("time_created"))).alias(first[m]) for m in marks])
    found = cases.join(pivot, "case_id")
    return found.dropDuplicates() if counted else found


def present_rules(dd_case: DataFrame, case_state_change: DataFrame, case_types: Sequence[str], catalog: RuleCatalog,
                  by: Sequence[str] = ()) -> DataFrame:
    """The distinct (by, profile, rule group) of all cases that have an event: ids and labels only."""
    cases = dd_case.filter(F.col("case_type").isin(list(case_types))).select(
        F.col("id").alias("case_id"), F.col("reference_id").alias("profile_id"), *by, classify_exact(F.col("metadata"), catalog).alias("rule_group"))
    return cases.join(case_state_change.select("case_id"), "case_id", "left_semi").select(*by, "profile_id", "rule_group").distinct()


def review_facts(dd_case: DataFrame, case_state_change: DataFrame, start: Column, end: Column,
                 loss: LossParams, precision: PrecisionParams, catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """day, profile_id, rule_name, rule_group and FACTS for the days of [start, end).

    On the day a case was created: ``cases`` of the loss type, ``timed_cases``
    of them with both a first assignment and a first close and the boundary
    ``minutes`` between these, ``created`` cases of the flag type.  On the day of its
    first assignment: ``assigned`` cases of the flag type, ``assigned_closed``
    of them in the closed state.  On the day of its first close: ``reviewed``
    cases of the loss type that are in the closed state.
    """
    rows = window_cases(dd_case, case_state_change, start, end, precision.case_types, closes=True, counted=True)
    is_loss, is_flag = F.col("case_type") == loss.case_type, upper_eq(F.col("case_type"), precision.flag_case_type)
    minutes = boundary_diff("MINUTE", F.col("case_assigned_time"), F.col("case_closed_time"))
    zero = F.lit(0).cast("long")

    def on(day: str, **counts: Column) -> Column:
        values = [F.coalesce(counts.get(f, zero).cast("long"), zero).alias(f) for f in FACTS]
        return F.struct(F.to_date(F.col(day)).alias("day"), *values)

    happened = F.array(
        on("time_created", cases=is_loss, timed_cases=is_loss & minutes.isNotNull(), minutes=F.when(is_loss, minutes), created=is_flag),
        on("case_assigned_time", assigned=is_flag, assigned_closed=is_flag & upper_eq(F.col("state"), precision.closed_state)),
        on("case_closed_time", reviewed=is_loss & (F.col("state") == loss.closed_state)))
    labels = [classify_contains(F.col("rule_triggered"), catalog).alias("rule_name"), classify_exact(F.col("rule_triggered"), catalog).alias("rule_group")]
    each = rows.select("profile_id", *labels, F.inline(happened)).filter(_between("day", start, end))
    some = " + ".join(f for f in FACTS if f not in ("timed_cases", "minutes", "assigned_closed")) + " > 0"
    return each.filter(some).groupBy("day", "profile_id", "rule_name", "rule_group").agg(*[F.sum(f).alias(f) for f in FACTS])


def write_months(facts: DataFrame, path: str) -> None:
    """Write facts by month; each month that ``facts`` holds replaces what the folder had of it, all others stay."""
    by_month = facts.withColumn("month", F.date_format("day", "yyyy-MM"))
    (by_month.repartition("month", F.pmod(F.xxhash64("profile_id"), F.lit(8))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def read_months(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """The facts of the days of [start, end); only the folders of their months are read."""
    last = (end - dt.timedelta(days=1)).strftime("%Y-%m")
    stored = spark.read.parquet(path).filter(F.col("month").cast("string").between(start.strftime("%Y-%m"), last))
    return stored.filter(_between("day", F.lit(start), F.lit(end))).drop("month")
