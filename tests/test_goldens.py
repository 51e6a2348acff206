"""Goldens from FIXTURES.md: LOSS and PRECISION at sf0.01, PLAN on the published inputs."""

import pytest

import __spark_entry__ as E
from reviewcap.operators import assignment as A
from reviewcap.operators import scoring as S
from reviewcap.params import DEFAULT_PLAN, LossParams
from reviewcap.sources import published_rule_inputs, published_top5_loss
from conftest import SF01

# rule: merch, paym, nof_n, nof_amt, cb_n, cb_amt, probl, total, flagged, offb, deact, precision
LOSS_PREC = {
    "Bin6AttemptedVolumeSpike": (368, 68, 10, 2783802.23, 12, 2188611.57, 15, 4972413.80, 44, 22, 8, 50.00),
    "PaymentForRequestRecentlyPublished": (336, 56, 7, 1861801.54, 10, 2115239.93, 11, 3977041.47, 52, 11, 9, 21.15),
    "WithdrawalRule": (355, 83, 6, 1591338.85, 9, 2328049.03, 11, 3919387.88, 29, 9, 3, 31.03),
    "Transaction_amount": (540, 71, 6, 948688.55, 14, 2415503.97, 18, 3364192.52, 108, 32, 18, 29.63),
    "UniqueCardsRefusedLast24HoursThresholdBreached_Reusable": (178, 50, 3, 833636.24, 13, 2312512.77, 13, 3146149.01, 23, 8, 3, 34.78),
    "UniqueCardsRefusedLast24HoursThresholdBreached_Wisetag": (189, 31, 2, 949406.16, 6, 1818580.70, 6, 2767986.86, 25, 10, 5, 40.00),
    "IssuerIcardADPattern": (184, 31, 5, 1137062.14, 7, 1510607.34, 7, 2647669.48, 30, 13, 4, 43.33),
    "IssuerAndMerchantConcentration": (191, 33, 3, 1002325.07, 7, 1486790.12, 8, 2489115.19, 30, 8, 8, 26.67),
    "emailAgeScoreAboveThreshold": (181, 27, 3, 788699.44, 7, 1497394.15, 6, 2286093.59, 29, 7, 8, 24.14),
    "PayerDisputeThreshold": (184, 29, 4, 1247825.34, 5, 653142.05, 9, 1900967.39, 29, 10, 4, 34.48),
    "HighRiskIssuerRefusalReason": (172, 32, 3, 913591.48, 6, 854785.70, 7, 1768377.18, 31, 6, 6, 19.35),
    "AverageDailyPayFacTransactionExceedsAverageDailyTransfer": (212, 47, 2, 53104.55, 8, 1392581.38, 8, 1445685.93, 37, 14, 7, 37.84),
    "LTVLowerThresholdBreached": (183, 25, 5, 838327.88, 5, 268574.12, 6, 1106902.00, 26, 10, 4, 38.46),
    "ProtonmailEmailDomain": (173, 29, 2, 633725.04, 4, 444305.92, 5, 1078030.96, 34, 6, 2, 17.65),
    "AbuserFlag": (199, 23, 1, 35803.46, 4, 979006.08, 4, 1014809.54, 31, 9, 8, 29.03),
    "UniqueCardsRefusedLast24HoursThresholdBreached": (192, 35, 1, 99010.90, 4, 398953.87, 5, 497964.77, 24, 10, 4, 41.67),
    "LTVHigherThresholdBreached": (193, 21, 3, 104035.68, 4, 369244.00, 5, 473279.68, 21, 6, 2, 28.57),
    "AttemptedAmountExceedsTransferAmount": (167, 19, 0, 0.00, 3, 464653.93, 2, 464653.93, 23, 5, 3, 21.74),
}


def test_loss_golden_sf001(spark):
    rows = {r.rule_group: r for r in E.queries()["rule_loss"](spark, SF01).collect()}
    assert set(rows) == set(LOSS_PREC)
    for rule, g in LOSS_PREC.items():
        r = rows[rule]
        got = (r.unique_merchants, r.total_payments, r.nof_payments, r.nof_amount_gbp, r.chargeback_payments,
               r.chargeback_amount_gbp, r.problematic_merchants, r.total_fraud_gbp)
        assert got[:3] == g[:3] and got[4] == g[4] and got[6] == g[6], rule
        assert got[3] == pytest.approx(g[3], abs=0.005) and got[5] == pytest.approx(g[5], abs=0.005)
        assert got[7] == pytest.approx(g[7], abs=0.005)


def test_loss_is_sorted_by_total(spark):
    totals = [r.total_fraud_gbp for r in E.queries()["rule_loss"](spark, SF01).collect()]
    assert totals == sorted(totals, reverse=True)


@pytest.mark.parametrize("key", ["rule_precision", "rule_precision_pruned"])
def test_precision_golden_sf001(spark, key):
    from reviewcap.catalog import DEFAULT_CATALOG
    bridge = dict(DEFAULT_CATALOG.bridge_rows())
    rows = {bridge[r.rule_group]: r for r in E.queries()[key](spark, SF01).collect()}
    assert set(rows) == set(LOSS_PREC)
    for rule, g in LOSS_PREC.items():
        r = rows[rule]
        assert (r.profiles_flagged_by_risk_rules, r.profiles_flagged_and_offboarded,
                r.profiles_flagged_by_rule_and_deactivated_by_fraud, r.precision_l3m) == g[8:], rule


def test_turnaround_row_count_sf001(spark):
    assert E.queries()["case_turnaround"](spark, SF01).count() == 44906


def _plan(spark, loss, precision_col, budget=75.0):
    p = DEFAULT_PLAN.with_(budget_weekly_hours=budget)
    sc = S.priority_scores(S.attach_loss(published_rule_inputs(spark), loss, LossParams()), p, precision_col)
    asg = A.review_assignment(sc, p)
    return asg, A.assignment_summary(asg, p).collect()[0]


def _zero(spark):
    return spark.createDataFrame([], "rule_group string, avg_fraud_per_problematic_merchant double")


# rule -> (zero/per case, zero/L3M, pub5/per case, pub5/L3M): score, type, hours
PLAN = {
    "AttemptedAmountExceedsTransferAmount": ((16.55, "Standard", 7.67), (21.25, "Standard", 7.67), (66.55, "Standard", 7.67), (71.25, "Standard", 7.67)),
    "AverageDailyPayFacTransactionExceedsAverageDailyTransfer": ((32.19, "Light", 73.0), (42.24, "Light", 73.0), (34.81, "Light", 73.0), (44.86, "Light", 73.0)),
    "Bin6AttemptedVolumeSpike": ((10.15, "Standard", 12.27), (22.74, "Standard", 12.27), (13.98, "Standard", 12.27), (26.57, "Standard", 12.27)),
    "HighRiskIssuerRefusalReason": ((15.57, "Standard", 4.83), (21.34, "Standard", 4.83), (15.57, "Standard", 4.83), (21.34, "Standard", 4.83)),
    "IssuerAndMerchantConcentration": ((8.87, "Light", 6.75), (14.67, "Light", 6.75), (8.87, "Light", 6.75), (14.67, "Light", 6.75)),
    "IssuerIcardADPattern": ((30.07, "Standard", 0.6), (30.07, "Standard", 0.6), (30.07, "Standard", 0.6), (30.07, "Standard", 0.6)),
    "LTVHigherThresholdBreached": ((1.94, "Deep", 16.5), (11.17, "Deep", 16.5), (1.94, "Deep", 16.5), (11.17, "Deep", 16.5)),
    "LTVLowerThresholdBreached": ((16.14, "Light", 16.75), (16.91, "Light", 16.75), (16.14, "Light", 16.75), (16.91, "Light", 16.75)),
    "PayerDisputeThreshold": ((0.26, "Standard", 2.22), (28.59, "Standard", 2.22), (0.26, "Standard", 2.22), (28.59, "Standard", 2.22)),
    "PaymentForRequestRecentlyPublished": ((13.61, "Standard", 10.73), (20.01, "Light", 3.5), (37.90, "Standard", 10.73), (44.29, "Standard", 10.73)),
    "ProtonmailEmailDomain": ((13.43, "Standard", 4.9), (18.22, "Standard", 4.9), (13.43, "Standard", 4.9), (18.22, "Standard", 4.9)),
    "Transaction_amount": ((6.01, "Standard", 17.87), (17.30, "Light", 16.75), (22.09, "Standard", 17.87), (33.38, "Standard", 17.87)),
    "UniqueCardsRefusedLast24HoursThresholdBreached": ((18.82, "Standard", 7.0), (26.21, "Standard", 7.0), (18.82, "Standard", 7.0), (26.21, "Standard", 7.0)),
    "UniqueCardsRefusedLast24HoursThresholdBreached_Reusable": ((13.03, "Light", 5.0), (25.17, "Standard", 12.67), (13.03, "Light", 5.0), (25.17, "Light", 5.0)),
    "UniqueCardsRefusedLast24HoursThresholdBreached_Wisetag": ((21.80, "Standard", 3.2), (25.37, "Standard", 3.2), (21.80, "Standard", 3.2), (25.37, "Standard", 3.2)),
    "WithdrawalRule": ((16.86, "Light", 19.25), (21.54, "Light", 19.25), (16.86, "Light", 19.25), (21.54, "Light", 19.25)),
    "emailAgeScoreAboveThreshold": ((13.71, "Standard", 4.98), (25.75, "Standard", 4.98), (13.71, "Standard", 4.98), (25.75, "Standard", 4.98)),
}
CASES = [("zero", "per_case_precision", 74.9962), ("zero", "rule_precision_l3m", 74.8385),
         ("pub5", "per_case_precision", 74.9962), ("pub5", "rule_precision_l3m", 74.9962)]


@pytest.mark.parametrize("col", range(4))
def test_plan_goldens(spark, col):
    loss_name, prec, hours = CASES[col]
    loss = _zero(spark) if loss_name == "zero" else published_top5_loss(spark)
    asg, summary = _plan(spark, loss, prec)
    assert round(summary.final_weekly_hours, 4) == hours
    got = {r.rule_name: (r.priority_score, r.proposed_review_type, r.proposed_time_hours) for r in asg.collect()}
    assert got == {k: v[col] for k, v in PLAN.items()}


def test_plan_minutes_and_l3m_default(spark):
    asg, summary = _plan(spark, published_top5_loss(spark), None)
    assert summary.final_total_minutes == 12811


@pytest.mark.parametrize("budget,hours,light", [(60, 68.7615, 16), (70, 69.9731, 11), (75, 74.9962, 5),
                                                 (80, 77.9077, 3), (90, 87.5808, 1), (111, 110.0423, 0)])
def test_budget_sweep(spark, budget, hours, light):
    _, s = _plan(spark, published_top5_loss(spark), "rule_precision_l3m", float(budget))
    assert round(s.final_weekly_hours, 4) == hours
    assert s.rules_at_light == light
    assert s.feasible == (hours <= budget)


def test_current_state_published(spark):
    r = S.current_state(published_rule_inputs(spark), DEFAULT_PLAN).collect()[0]
    assert r.current_monthly_hours == pytest.approx(365.39)
    assert round(r.current_weekly_hours, 4) == 104.3208
    assert round(r.reduction_needed_hours, 4) == 29.3208
    assert round(r.reduction_needed_pct, 3) == 28.106
    assert round(r.current_weekly_hours_with_overhead, 4) == 110.0423


@pytest.mark.parametrize("sf,counts", [
    ("/root/testdata/sf0.001", (4599, 13043, 150, 1500, 6000)),
    ("/root/testdata/sf0.01", (45832, 129449, 1500, 15000, 60000)),
])
def test_fixture_row_counts(spark, sf, counts):
    from reviewcap.sources import fixture_tables
    t = fixture_tables(spark, sf)
    got = tuple(df.count() for df in (t.dd_case, t.case_state_change, t.merchants, t.payments, t.requests))
    assert got == counts


def test_unfiltered_spine_counts_sf001(spark):
    from pyspark.sql import functions as F
    from reviewcap.operators.precision import request_payment_merchant_spine
    from reviewcap.params import FIXTURE_PRECISION
    from reviewcap.sources import fixture_tables
    t = fixture_tables(spark, SF01)
    spine = request_payment_merchant_spine(t.requests, t.payments, t.merchants, FIXTURE_PRECISION, apply_filter=False)
    r = spine.agg(F.count(F.lit(1)).alias("n"), F.count("r_payment_request_id").alias("req"),
                  F.count("card_attempt_id").alias("pay"), F.count("profile_id").alias("m")).collect()[0]
    assert (r.n, r.req, r.pay, r.m) == (62706, 60000, 28407, 28407)


def test_capacity_comparison_single_team(spark):
    p = DEFAULT_PLAN
    ri = published_rule_inputs(spark)
    asg = A.review_assignment(S.priority_scores(S.attach_loss(ri, published_top5_loss(spark), LossParams()), p), p)
    df = A.capacity_comparison(asg, p)
    r = df.collect()[0]
    assert round(r.current_weekly_hours_with_overhead, 4) == 110.0423
    assert round(r.final_weekly_hours, 4) == 74.9962 and r.feasible
    assert round(r.hours_saved_weekly, 4) == round(110.0423076923077 - 74.99615384615385, 4)
    assert round(r.current_weekly_hours, 4) == 104.3208
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
