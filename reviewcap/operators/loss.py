"""LOSS: money lost per rule after a merchant's first case, until offboarding."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewcap.catalog import DEFAULT_CATALOG, RuleCatalog
from reviewcap.functions import money_text, problematic_payment, round2_half_even
from reviewcap.operators.cases import first_case_per_profile_rule
from reviewcap.params import LossParams, as_of_col
from reviewcap.sources.sinks import store_once

MONEY = "decimal(18,2)"
SALT_COL = "_salt"  # stored payment salt, see sources.layout
DEFAULT_SALT = 8  # join keys a profile's payments are spread over, where pairs are formed


def _zero():
    return F.lit(0).cast(MONEY)


def _payments(payments: DataFrame, params: LossParams) -> DataFrame:
    """Successful payments, with the derived lower time bound pushed to the scan.

    A payment counts only after a case created no earlier than the window
    start, so ``attempt_time > window start`` holds for every match; stating
    it prunes row groups / partitions of the largest table.
    """
    cond = F.col("successful_transaction_flag") == params.success_flag
    if params.as_of is None or isinstance(params.as_of, dt.date):
        cond = cond & (F.col("attempt_time") > F.add_months(as_of_col(params.as_of), -params.window_months))
    stored_salt = [SALT_COL] if SALT_COL in payments.columns else []
    return payments.filter(cond).select(
        F.col("profile_id").alias("_pay_profile_id"),
        "card_attempt_id", "attempt_time",
        F.col("attempted_gbp_amount_gross").cast(MONEY).alias("attempted_gbp_amount_gross"),
        "fraud_flag",
        F.col("chargeback_amount_gbp").cast(MONEY).alias("chargeback_amount_gbp"),
        *stored_salt,
    )


def _range_cond(left: DataFrame, right: DataFrame, extra_keys: Sequence[str] = ()):
    cond = ((left["profile_id"] == right["_pay_profile_id"])
            & (right["attempt_time"] > left["created_time"])
            & (right["attempt_time"] <= left["date_offboarded"]))
    for k in extra_keys:
        cond = cond & (left[k] == right[k])
    return cond


def _salted(left: DataFrame, pay: DataFrame, params: LossParams) -> tuple[DataFrame, DataFrame, list[str]]:
    """With S > 1 salt buckets: payments keep (or get) a salt in [0, S), the case side is copied S times."""
    n = DEFAULT_SALT if params.salt_buckets is None else params.salt_buckets
    if n <= 1:
        return left, pay, []
    if SALT_COL not in pay.columns:
        pay = pay.withColumn(SALT_COL, F.pmod(F.xxhash64("card_attempt_id"), F.lit(n)))
    left = left.withColumn(SALT_COL, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    return left, pay, [SALT_COL]


def post_case_payments(first_cases: DataFrame, merchants: DataFrame, payments: DataFrame,
                       params: LossParams) -> DataFrame:
    """J1 + J2: first cases LEFT JOIN merchants LEFT JOIN payments (range condition).

    One row per (first case, matching payment); first cases with no payment
    keep one row with NULL payment columns.  The payment upper bound comes
    from the merchant join, so never-offboarded merchants match nothing.

    The matching pairs are the salted inner range join, written once to the
    shared folder; the cases that matched nothing are the rest, found with an
    anti join against the keys in those files.  So payments are read and
    dealt out once, and no outer join holds a hot merchant's payments
    together.  Same rows as the literal left joins (tested against them and
    the oracle).
    """
    m = merchants.select("profile_id", "date_offboarded")
    left = first_cases.join(m, "profile_id", "left")
    keys = list(left.columns)
    p = _payments(payments, params)
    lj, pj, extra = _salted(left, p, params)
    pay_cols = ["card_attempt_id", "attempted_gbp_amount_gross", "fraud_flag", "chargeback_amount_gbp"]
    matched = store_once(lj.join(pj, _range_cond(lj, pj, extra), "inner").select(*[lj[c] for c in keys], *pay_cols),
                         "matched-payments")
    hit = matched.select(*[F.col(c).alias(f"_hit_{c}") for c in keys]).distinct()
    null_safe = None
    for c in keys:
        eq = left[c].eqNullSafe(hit[f"_hit_{c}"])
        null_safe = eq if null_safe is None else null_safe & eq
    unmatched = left.join(hit, null_safe, "left_anti").select(
        *keys, *[F.lit(None).cast(p.schema[c].dataType).alias(c) for c in pay_cols])
    out = matched.unionByName(unmatched)
    return out.select(
        *[c for c in first_cases.columns if c not in ("profile_id", "created_time")],
        "profile_id", *pay_cols, "date_offboarded",
    )


def post_case_payments_literal(first_cases: DataFrame, merchants: DataFrame, payments: DataFrame,
                               params: LossParams) -> DataFrame:
    """J1 + J2 exactly as written (outer joins); the reference form for tests."""
    m = merchants.select("profile_id", "date_offboarded")
    left = first_cases.join(m, "profile_id", "left")
    p = _payments(payments, params)
    j = left.join(p, _range_cond(left, p), "left")
    return j.select(
        *[c for c in first_cases.columns if c not in ("profile_id", "created_time")],
        "profile_id", "card_attempt_id", "attempted_gbp_amount_gross", "fraud_flag",
        "chargeback_amount_gbp", "date_offboarded",
    )


# What a payment adds to each total, as whole numbers (money in pence).
MEASURES = {
    "total_payments": "CAST(card_attempt_id IS NOT NULL AS BIGINT)",
    "nof_payments": "CAST(coalesce(fraud_flag, false) AS BIGINT)",
    "nof_amount_gbp": "CASE WHEN fraud_flag THEN CAST(attempted_gbp_amount_gross * 100 AS BIGINT) END",
    "chargeback_payments": "CAST(chargeback_amount_gbp IS NOT NULL AS BIGINT)",
    "chargeback_amount_gbp": "CAST(chargeback_amount_gbp * 100 AS BIGINT)",
    "_problematic": "CAST(chargeback_amount_gbp IS NOT NULL OR coalesce(fraud_flag, false) AS BIGINT)",
}


def loss_per_profile(first_cases: DataFrame, merchants: DataFrame, payments: DataFrame,
                     params: LossParams, keys: Sequence[str]) -> DataFrame:
    """Per (keys, profile): the payments after the first case until offboarding, counted and summed.

    By prefix sums; by the range join where ``salt_buckets`` asks for it or
    payments are stored with a salt, whose buckets the join needs.
    """
    by_join = params.salt_buckets is not None or SALT_COL in payments.columns
    return (loss_per_profile_by_join if by_join else loss_per_profile_by_prefix)(first_cases, merchants, payments, params, keys)


def _time_bucket(t: str, per_day: int) -> str:
    """A whole number that grows with time: the day, or the part of it."""
    day = f"CAST(unix_date(to_date({t})) AS BIGINT)"
    return day if per_day <= 1 else f"{day} * {per_day} + hour({t}) * {per_day} DIV 24"


def loss_per_profile_by_prefix(first_cases: DataFrame, merchants: DataFrame, payments: DataFrame,
                               params: LossParams, keys: Sequence[str]) -> DataFrame:
    """``loss_per_profile`` without pairs of cases and payments: sums until offboarding less sums until the case.

    All measures are counts or sums, so a case needs two points of its
    merchant's running sums.  Points and payments are dealt out by (profile,
    time bucket): running sums within a bucket leave the points and one total
    a bucket, and running sums over a merchant's bucket totals give the rest.
    Rows are payments + cases whatever the number of rules, both are
    scanned once, and a hot merchant is split by its buckets.  A case without
    an offboarding after it has one point that counts nothing.
    """
    pay = _payments(payments, params)
    time = pay.schema["attempt_time"].dataType.simpleString()
    own = ["`" + c.replace("`", "``") + "`" for c in dict.fromkeys([*keys, "profile_id"])]
    types = [f.dataType.simpleString() for c in dict.fromkeys([*keys, "profile_id"]) for f in first_cases.schema.fields if f.name == c]
    # The lower bound that a date gives (``_payments``) leaves no null times.
    timed = "" if params.as_of is None or isinstance(params.as_of, dt.date) else " AND attempt_time IS NOT NULL"
    pays = pay.filter("_pay_profile_id IS NOT NULL" + timed).selectExpr(
        "_pay_profile_id AS _pid", "attempt_time AS _t", "0 AS _sign", "false AS _point", f"{_time_bucket('attempt_time', params.buckets_per_day)} AS _bucket",
        *[f"CAST(NULL AS {k}) AS {c}" for c, k in zip(own, types)], *[f"{e} AS _{m}" for m, e in MEASURES.items()])
    left = first_cases.join(merchants.select("profile_id", "date_offboarded"), "profile_id", "left")
    start, end = f"CAST(created_time AS {time})", f"CAST(date_offboarded AS {time})"
    after, point = f"{end} > {start}", "named_struct('_t', {}, '_sign', {})".format
    points = left.selectExpr(*own, f"inline(IF({after}, array({point(start, -1)}, {point(end, 1)}), array({point(start, 0)})))")
    points = points.selectExpr("profile_id AS _pid", "_t", "_sign", "true AS _point", f"{_time_bucket('_t', params.buckets_per_day)} AS _bucket", *own,
                               *[f"CAST(NULL AS BIGINT) AS _{m}" for m in MEASURES])
    inner = "PARTITION BY _pid, _bucket ORDER BY _t, _point"  # payments at a point's time come before it
    upto = f"OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = pays.unionByName(points).selectExpr("_pid", "_bucket", "_sign", "_point", *own, *[f"sum(_{m}) {upto} AS _{m}" for m in MEASURES],
                                               f"lead(_point) OVER ({inner}) IS NULL AS _last").filter("_point OR _last")
    before = "OVER (PARTITION BY _pid ORDER BY _bucket RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    points = rows.selectExpr("_point", *own, *[f"_sign * (coalesce(_{m}, 0) + coalesce(sum(IF(_last, _{m}, 0)) {before}, 0)) AS _{m}" for m in MEASURES]).filter("_point")
    sums = points.groupBy(*own).agg(*[F.sum(f"_{m}").alias(f"_{m}") for m in MEASURES])
    made = {m: f"_{m}" for m in MEASURES} | {"_problematic": "CAST(__problematic > 0 AS INT)"}
    made |= {m: f"CAST(CAST(_{m} AS DECIMAL(26, 0)) * 0.01 AS DECIMAL(28, 2))" for m in ("nof_amount_gbp", "chargeback_amount_gbp")}
    return sums.selectExpr(*own, *[f"{e} AS {m}" for m, e in made.items()])


def loss_per_profile_by_join(first_cases: DataFrame, merchants: DataFrame, payments: DataFrame,
                             params: LossParams, keys: Sequence[str]) -> DataFrame:
    """``loss_per_profile`` by pairs of cases and payments.

    One left range join.  Each merchant's payments are spread over
    ``salt_buckets`` join keys and the (small) case side is copied to each, so
    a hot merchant is split although the join is an outer one; the copies of a
    case that match nothing carry NULL payments and add nothing.  When
    payments are stored with a ``_salt`` column (``sources.layout``), that
    salt is used, so a table bucketed by (profile_id, _salt) is joined
    without being shuffled; ``salt_buckets`` must then be the layout's.
    Grouping is null-safe: a NULL key is a group.
    """
    m = merchants.select("profile_id", "date_offboarded")
    left, p, extra = _salted(first_cases.join(m, "profile_id", "left"), _payments(payments, params), params)
    j = left.join(p, _range_cond(left, p, extra), "left").select(
        *[left[c] for c in first_cases.columns], "card_attempt_id", "attempted_gbp_amount_gross", "fraud_flag",
        "chargeback_amount_gbp")
    fraud = F.coalesce(F.col("fraud_flag"), F.lit(False))
    amt, cb = F.col("attempted_gbp_amount_gross"), F.col("chargeback_amount_gbp")
    return j.groupBy(*keys, "profile_id").agg(
        F.count("card_attempt_id").alias("total_payments"),
        F.count_if(fraud).alias("nof_payments"),
        F.sum(F.when(fraud, amt).otherwise(_zero())).alias("nof_amount_gbp"),
        F.count(cb).alias("chargeback_payments"),
        F.sum(F.coalesce(cb, _zero())).alias("chargeback_amount_gbp"),
        F.max(problematic_payment(F.col("fraud_flag"), cb).cast("int")).alias("_problematic"),
    )


def loss_per_rule(per_profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ten LOSS columns per ``keys`` from one row per (keys, profile), money as exact decimals."""
    j = per_profile.groupBy(*keys).agg(
        F.count("profile_id").alias("unique_merchants"),
        F.sum("total_payments").alias("total_payments"),
        F.sum("nof_payments").alias("nof_payments"),
        F.sum("nof_amount_gbp").alias("nof_amount_gbp"),
        F.sum("chargeback_payments").alias("chargeback_payments"),
        F.sum("chargeback_amount_gbp").alias("chargeback_amount_gbp"),
        F.sum(F.when(F.col("profile_id").isNotNull(), F.col("_problematic"))).alias("problematic_merchants"),
    )
    z = F.lit(0).cast("long")
    nof = F.coalesce(F.col("nof_amount_gbp"), _zero())
    cbs = F.coalesce(F.col("chargeback_amount_gbp"), _zero())
    prob = F.coalesce(F.col("problematic_merchants"), z)
    total = nof + cbs
    return j.select(
        *keys,
        F.col("unique_merchants").cast("long").alias("unique_merchants"),
        F.coalesce(F.col("total_payments"), z).cast("long").alias("total_payments"),
        F.coalesce(F.col("nof_payments"), z).cast("long").alias("nof_payments"),
        nof.alias("nof_amount_gbp"),
        F.coalesce(F.col("chargeback_payments"), z).cast("long").alias("chargeback_payments"),
        cbs.alias("chargeback_amount_gbp"),
        prob.cast("long").alias("problematic_merchants"),
        total.alias("total_fraud_gbp"),
        F.when(prob > 0, total.cast("double") / prob.cast("double")).otherwise(F.lit(0.0))
        .alias("avg_fraud_per_problematic_merchant"),
    )


def rule_loss_exact(first_cases: DataFrame, merchants: DataFrame, payments: DataFrame,
                    params: LossParams, by: Sequence[str] = ()) -> DataFrame:
    """Per rule group: the ten LOSS columns, money as exact decimals.

    Two-level aggregation instead of several COUNT(DISTINCT): payments are
    first summed per (rule, profile), then per rule, where every map task
    sends at most one row per rule.  Cases and payments are scanned once.
    """
    keys = [*by, "rule_group"]
    return loss_per_rule(loss_per_profile(first_cases, merchants, payments, params, keys), keys)


MONEY_COLS = ("nof_amount_gbp", "chargeback_amount_gbp", "total_fraud_gbp")


def rule_loss(dd_case: DataFrame, merchants: DataFrame, payments: DataFrame,
              params: LossParams, catalog: RuleCatalog = DEFAULT_CATALOG,
              by: Sequence[str] = ()) -> DataFrame:
    """The loss table by rule, money as double, sorted by total loss (ties by rule)."""
    first = first_case_per_profile_rule(dd_case, params, catalog, by)
    exact = rule_loss_exact(first, merchants, payments, params, by)
    out = exact.withColumns({c: F.col(c).cast("double") for c in MONEY_COLS})
    return out.orderBy(*by, F.desc("total_fraud_gbp"), "rule_group")


def rule_loss_summary(dd_case: DataFrame, merchants: DataFrame, payments: DataFrame,
                      params: LossParams, catalog: RuleCatalog = DEFAULT_CATALOG,
                      by: Sequence[str] = ()) -> DataFrame:
    """Totals over rules and the monthly average; sums are exact decimals.

    "Total merchants" adds per-rule distinct counts, as the source does.  An
    empty loss table gives zeros, not an error.
    """
    first = first_case_per_profile_rule(dd_case, params, catalog, by)
    exact = rule_loss_exact(first, merchants, payments, params, by)
    z = F.lit(0).cast("long")
    total = F.coalesce(F.sum("total_fraud_gbp"), _zero())
    agg = exact.groupBy(*by) if by else exact
    return agg.agg(
        F.coalesce(F.sum("unique_merchants"), z).cast("long").alias("total_merchants"),
        F.coalesce(F.sum("problematic_merchants"), z).cast("long").alias("total_problematic_merchants"),
        F.coalesce(F.sum("total_payments"), z).cast("long").alias("total_payments"),
        F.coalesce(F.sum("nof_amount_gbp"), _zero()).cast("double").alias("total_nof_amount_gbp"),
        F.coalesce(F.sum("chargeback_amount_gbp"), _zero()).cast("double").alias("total_chargeback_amount_gbp"),
        total.cast("double").alias("total_fraud_gbp"),
        (total.cast("double") / F.lit(float(params.window_months))).alias("monthly_avg_fraud_gbp"),
    )


def rule_loss_display(loss: DataFrame) -> DataFrame:
    """D3: money as '£1,234.56' text and the average rounded half-even to 2 places."""
    return loss.withColumns({
        **{c: money_text(F.col(c)) for c in MONEY_COLS},
        "avg_fraud_per_problematic_merchant": round2_half_even(F.col("avg_fraud_per_problematic_merchant")),
    })
