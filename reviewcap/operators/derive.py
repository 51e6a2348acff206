"""Planning inputs derived from the tables (the source types them in by hand).

X1 per-case precision, X2 cases per month, X3 handling time, X4 rule
precision bridged to the loss labels, X5 precision over a list of as-of
dates.  The source gives definitions in prose only; the choices made here
are stated on each function and are flagged as derived.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewcap.catalog import DEFAULT_CATALOG, RuleCatalog
from reviewcap.functions import half_open_window, not_equal_keep_null, pct_half_up
from reviewcap.operators.cases import first_case_per_profile_rule
from reviewcap.operators.facts import review_facts
from reviewcap.operators.loss import MONEY_COLS, loss_per_profile, loss_per_rule
from reviewcap.operators.precision import merchant_filter
from reviewcap.params import LossParams, PrecisionParams, as_of_col


def half_up_ratio(num: Column, den: Column) -> Column:
    """``floor((2 * num + den) / (2 * den))``: a ratio rounded half up to a whole number."""
    return F.floor((F.lit(2) * num + den).cast("double") / (F.lit(2) * den).cast("double")).cast("long")


def bridge_frame(spark: SparkSession, catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """precision label -> loss label, one row per rule plus the fallback (|catalog| + 1 rows)."""
    return spark.createDataFrame(catalog.bridge_rows(), "precision_label string, rule_name string")


def merchant_states(merchants: DataFrame, params: PrecisionParams) -> DataFrame:
    """One row per profile: acted on at all (offboarded for a reason not hidden, or deactivated), and, of its
    accepted rows (``merchant_filter``), whether there is one and one offboarded or deactivated."""
    offboarded = F.col("date_offboarded").isNotNull() & not_equal_keep_null(F.col("offboarding_reason"), params.hidden_reason)
    deactivated, accepted = F.col("deactivation_reason").isNotNull(), merchant_filter(params)
    states = {"_acted": offboarded | deactivated, "_accepted": accepted, "_offboarded": accepted & offboarded, "_deactivated": accepted & deactivated}
    return merchants.filter(F.col("profile_id").isNotNull()).groupBy(F.col("profile_id").alias("_merchant_id")).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in states.items()])


def derived_rule_inputs(spark: SparkSession, dd_case: DataFrame, case_state_change: DataFrame,
                        merchants: DataFrame, loss_params: LossParams, precision_params: PrecisionParams,
                        catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """X1-X4 from the tables: ``rule_inputs_from_facts`` of the days that the two windows span."""
    start, end = facts_span(loss_params, precision_params)
    facts = review_facts(dd_case, case_state_change, start, end, loss_params, precision_params, catalog)
    return rule_inputs_from_facts(spark, facts, merchants, loss_params, precision_params, catalog)


def facts_span(loss_params: LossParams, precision_params: PrecisionParams) -> tuple[Column, Column]:
    """The first day of the earlier window and the day after the later one."""
    lo, po = as_of_col(loss_params.as_of), as_of_col(precision_params.as_of)
    return (F.least(F.add_months(lo, -loss_params.window_months), F.add_months(po, -precision_params.window_months)).cast("date"),
            F.greatest(lo, po).cast("date"))


def rule_inputs_from_facts(spark: SparkSession, facts: DataFrame, merchants: DataFrame, loss_params: LossParams,
                           precision_params: PrecisionParams, catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """X1-X4 per loss label (every catalog rule plus the fallback, zeros when idle), from ``review_facts``.

    * X2 ``avg_cases_per_month``: cases of the loss case type created in the
      half-open loss window, per month, rounded half up.
    * X3 ``avg_handling_time_minutes``: mean boundary minutes from assignment
      to close over those cases that have both, rounded half up.
    * X1 ``per_case_precision``: of the cases of the loss type closed within
      the precision window, the % whose merchant was offboarded (reason not
      hidden) or deactivated.
    * X4 ``rule_precision_l3m``: PRECISION (merchant-first form) mapped to the
      loss label through the catalog bridge; 0.0 when nothing was flagged.

    Days are added up per (profile, rule) first, so a hot merchant is a few
    rows where merchants are joined; both kinds of measures then go through
    the same two groupings.  Nothing runs when this is called.
    """
    in_loss = half_open_window(F.col("day"), as_of_col(loss_params.as_of), loss_params.window_months)
    in_precision = half_open_window(F.col("day"), as_of_col(precision_params.as_of), precision_params.window_months)
    windows = {"cases": in_loss, "timed_cases": in_loss, "minutes": in_loss, "reviewed": in_precision, "assigned": in_precision,
               "assigned_closed": in_precision}
    merged = facts.groupBy("profile_id", "rule_name", "rule_group").agg(
        *[F.coalesce(F.sum(F.when(w, F.col(f))), F.lit(0)).cast("long").alias(f) for f, w in windows.items()])
    known = merged.join(merchant_states(merchants, precision_params), F.col("profile_id") == F.col("_merchant_id"), "left")
    names: dict[str, list[str]] = {}
    for group, name in catalog.bridge_rows():
        names.setdefault(group, []).append(name)
    targets = F.create_map(*[x for g, n in names.items() for x in (F.lit(g), F.array(*map(F.lit, n)))])[F.col("rule_group")]
    zero, no = F.lit(0).cast("long"), F.lit(False)
    counts = ("cases", "timed_cases", "minutes", "reviewed", "actioned")

    def row(name: Column, profile: Column, values: dict[str, Column], flagged: Column, acted_on: Column) -> Column:
        return F.struct(name.alias("name"), profile.alias("profile"), *[values.get(c, zero).alias(c) for c in counts],
                        flagged.alias("flagged"), acted_on.alias("offboarded"))

    own = {c: F.col(c) for c in counts[:-1]} | {"actioned": F.when(F.col("_acted"), F.col("reviewed")).otherwise(zero)}
    flagged = F.coalesce(F.col("_accepted"), no) & (F.col("assigned") > 0)
    offboarded = F.coalesce(F.col("_offboarded"), no) & (F.col("assigned_closed") > 0)
    # A rule's counts need no profile; its flags are counted by profile and go to every loss label of its group.
    each = known.select(F.inline(F.concat(F.array(row(F.col("rule_name"), F.lit(None).cast("string"), own, no, no)),
                                          F.transform(targets, lambda n: row(n, F.col("profile_id"), {}, flagged, offboarded)))))
    per_profile = each.groupBy("name", "profile").agg(*[F.sum(c).alias(c) for c in counts], F.max("flagged").alias("flagged"), F.max("offboarded").alias("offboarded"))
    per_rule = per_profile.groupBy("name").agg(*[F.sum(c).alias(c) for c in counts], F.count_if("flagged").alias("flagged"),
                                               F.count_if("offboarded").alias("offboarded"))
    bridge = F.broadcast(bridge_frame(spark, catalog))  # |catalog| + 1 rows
    j = bridge.join(per_rule, F.col("rule_name") == F.col("name"), "left")
    months = F.lit(loss_params.window_months).cast("long")
    return j.select(
        "rule_name",
        F.coalesce(pct_half_up(F.col("offboarded"), F.col("flagged")), F.lit(0.0)).alias("rule_precision_l3m"),
        F.coalesce(pct_half_up(F.col("actioned"), F.col("reviewed")), F.lit(0.0)).alias("per_case_precision"),
        F.coalesce(half_up_ratio(F.col("cases"), months), zero).cast("int").alias("avg_cases_per_month"),
        F.coalesce(F.when(F.col("timed_cases") > 0, half_up_ratio(F.col("minutes"), F.col("timed_cases"))), zero)
        .cast("int").alias("avg_handling_time_minutes"),
        F.coalesce(F.col("cases"), zero).cast("long").alias("cases_in_window"),
        F.coalesce(F.col("reviewed"), zero).cast("long").alias("reviewed_cases"),
        F.coalesce(F.col("actioned"), zero).cast("long").alias("actioned_cases"),
    )


def with_current_types(derived: DataFrame, current: DataFrame, default: str = "Standard") -> DataFrame:
    """Attach each rule's current review type (a small parameter table); ``default`` otherwise."""
    cur = current.select("rule_name", F.col("current_review_type").alias("_cur"))
    return (derived.join(cur, "rule_name", "left")
            .withColumn("current_review_type", F.coalesce(F.col("_cur"), F.lit(default))).drop("_cur"))


def add_months(d: dt.date, months: int) -> dt.date:
    """The date so many months later, or the last day of that month where it is shorter."""
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def month_starts(end: dt.date, n: int) -> list[dt.date]:
    """``n`` first-of-month dates ending at ``end``'s month (oldest first)."""
    out, y, m = [], end.year, end.month
    for _ in range(n):
        out.append(dt.date(y, m, 1))
        y, m = (y, m - 1) if m > 1 else (y - 1, 12)
    return out[::-1]


def _spans(as_of_dates: Sequence[dt.date], months: int, open_end: bool = False) -> tuple[list[dt.date], list[list[dt.date]]]:
    """The days at which some date's window starts (or ends), sorted, and for each span that begins there the dates whose window holds it."""
    dates = sorted(set(as_of_dates))
    cuts = sorted({add_months(d, -months) for d in dates} | (set() if open_end else set(dates)))
    return cuts, [[d for d in dates if add_months(d, -months) <= c and (open_end or c < d)] for c in cuts]


def _span_of(day: Column, cuts: Sequence[dt.date]) -> Column:
    """The number of the span that a day lies in (0: before the first)."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= day))


def _dates_of(span: Column, dates: Sequence[Sequence[dt.date]]) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(d) for d in ds]).cast("array<date>") for ds in dates]), span)


def rule_precision_trend(merchants: DataFrame, dd_case: DataFrame, case_state_change: DataFrame,
                         as_of_dates: Sequence[dt.date], params: PrecisionParams,
                         catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """PRECISION at each as-of date; rows where the rule flagged someone (``precision_trend_from_facts``)."""
    start = F.lit(_spans(as_of_dates, params.window_months)[0][0])
    facts = review_facts(dd_case, case_state_change, start, F.lit(max(as_of_dates)), LossParams(), params, catalog)
    return precision_trend_from_facts(merchants, facts, as_of_dates, params)


def precision_trend_from_facts(merchants: DataFrame, facts: DataFrame, as_of_dates: Sequence[dt.date],
                               params: PrecisionParams) -> DataFrame:
    """X5 from ``review_facts`` of the days that the dates' windows span.

    The starts and ends of all windows cut time into spans (months, where the
    dates are first days of months).  Facts are added up per (profile, rule,
    span) once, and each date merges the spans of its window: what is copied
    to dates is a sum of a span, not a case.
    """
    cuts, dates = _spans(as_of_dates, params.window_months)
    spans = facts.withColumn("_span", _span_of(F.col("day"), cuts)).filter("_span > 0").groupBy("profile_id", "rule_group", "_span").agg(
        *[F.max(F.col(f) > 0).alias(f) for f in ("assigned", "assigned_closed", "created")]).filter("assigned OR created")
    by_date = spans.select("profile_id", "rule_group", "assigned", "assigned_closed", "created", F.explode(_dates_of(F.col("_span"), dates)).alias("as_of"))
    states = merchant_states(merchants, params).filter("_accepted")
    per_profile = by_date.join(states, F.col("profile_id") == F.col("_merchant_id")).groupBy("as_of", "rule_group", "profile_id").agg(
        F.max("assigned").alias("f1"), F.max(F.col("assigned_closed") & F.col("_offboarded")).alias("f2"), F.max(F.col("created") & F.col("_deactivated")).alias("f3"))
    per_rule = per_profile.groupBy("as_of", "rule_group").agg(*[F.count_if(f).alias(f) for f in ("f1", "f2", "f3")]).filter("f1 > 0")
    return per_rule.select("as_of", "rule_group", F.col("f1").alias("profiles_flagged_by_risk_rules"), F.col("f2").alias("profiles_flagged_and_offboarded"),
                           F.col("f3").alias("profiles_flagged_by_rule_and_deactivated_by_fraud"), pct_half_up(F.col("f2"), F.col("f1")).alias("precision_l3m"),
                           ).orderBy("as_of", "rule_group")


def rule_loss_trend(dd_case: DataFrame, merchants: DataFrame, payments: DataFrame,
                    as_of_dates: Sequence[dt.date], params: LossParams,
                    catalog: RuleCatalog = DEFAULT_CATALOG) -> DataFrame:
    """LOSS at each as-of date (the loss window has no upper bound, as in LOSS).

    The starts of all windows cut time into spans.  Cases are reduced to the
    first of each (rule, profile, span); a date's first case is the least of
    the spans from its start on.  The distinct first cases - most dates share
    theirs - meet payments once, and only the sums per case are expanded to
    dates.  Cases and payments keep the lower bound of the earliest window.
    """
    cuts, dates = _spans(as_of_dates, params.window_months, open_end=True)
    earliest = F.lit(cuts[0])
    base = params.with_(as_of=F.add_months(earliest, params.window_months))
    cases = dd_case.filter(F.col("time_created") >= earliest).withColumn("_span", _span_of(F.to_date("time_created"), cuts)).filter("_span > 0")
    spans = first_case_per_profile_rule(cases, base, catalog, ("_span",))
    per_date = spans.withColumn("as_of", F.explode(_dates_of(F.col("_span"), dates))).groupBy("as_of", "rule_group", "profile_id").agg(F.min("created_time").alias("created_time"))
    first = per_date.groupBy("rule_group", "profile_id", "created_time").agg(F.collect_list("as_of").alias("dates"))
    pays = payments.filter(F.col("attempt_time") > earliest)
    per_case = loss_per_profile(first, merchants, pays, params.with_(as_of="as_of"), ("rule_group", "created_time", "dates"))
    exact = loss_per_rule(per_case.withColumn("as_of", F.explode("dates")), ("as_of", "rule_group"))
    return exact.withColumns({c: F.col(c).cast("double") for c in MONEY_COLS})
