
import datetime as dt

import pytest

from pyspark.sql import functions as F

from helpers import ACQ, AS_OF, BIN6, PF, WITHDRAWAL, cases, events, merchants, payments, rule_inputs, ts
from reviewcap.functions import boundary_diff, classify_contains, classify_exact, pct_half_up, round2_half_even
from reviewcap.operators import assignment as A
from reviewcap.operators import loss as L
from reviewcap.operators import precision as P
from reviewcap.operators import scoring as S
from reviewcap.operators.cases import case_review_times
from reviewcap.params import DEFAULT_PLAN, LossParams, PrecisionParams
from reviewcap.sources import duplicate_keys

UC = "Rule fired - o_UniqueCardsRefusedLast24HoursThresholdBreached_PauseMerchant"


def classify(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    return [r[1] for r in df.select("i", fn(F.col("m"))).orderBy("i").collect()]


def test_h1_to_h5_classification(spark):
    texts = [
        UC.replace("o_", "oX").replace("_PauseMerchant", "XPauseMerchant"),  # H1: _ is a wildcard
        WITHDRAWAL + " (dup)",                                              # H2: no trailing %
        "note: " + WITHDRAWAL,                                              # H2/H5: text before
        "xx PaymentForRequestRecentlyPublished " + BIN6,                    # H3: first match wins
        None,                                                               # H4
        "Amount over limit",                                                # H4
        BIN6.upper(),                                                       # H5: case-insensitive
    ]
    assert classify(spark, texts, classify_contains) == [
        "UniqueCardsRefusedLast24HoursThresholdBreached", "Transaction_amount", "WithdrawalRule",
        "PaymentForRequestRecentlyPublished", "Transaction_amount", "Transaction_amount",
        "Bin6AttemptedVolumeSpike"]
    assert classify(spark, texts, classify_exact) == [
        "Transaction amount", "Transaction amount", "Transaction amount", "Transaction amount",
        "Transaction amount", "Transaction amount", "BIN Spike"]


def _loss_tables(spark, dup_merchant=False):
    c = cases(spark, [
        (1, "A", ts(2000, 2, 1), ACQ, "CLOSED", BIN6),
        (2, "A", ts(2000, 3, 1), ACQ, "CLOSED", BIN6),          # later case, same rule: first wins
        (3, "B", ts(2000, 2, 1), ACQ, "CLOSED", BIN6),          # never offboarded (H6)
        (4, "A", ts(2000, 4, 1), ACQ, "CLOSED", WITHDRAWAL),    # same profile, second rule (H12)
        (5, "C", ts(1999, 12, 31), ACQ, "CLOSED", BIN6),        # before the window
        (6, "C", ts(2000, 5, 1), ACQ, "OPEN", BIN6),            # not closed (H15)
        (7, "C", ts(2000, 5, 1), "OTHER", "CLOSED", BIN6),      # other case type
        (8, "D", ts(2000, 8, 1), ACQ, "CLOSED", "Amount over limit"),  # after as-of: kept (H13)
    ])
    mrows = [("A", dt.date(2000, 9, 1), "FRAUD", None, "OFFBOARDED"),
             ("B", None, None, None, "onboarded"),
             ("C", dt.date(2000, 9, 1), None, None, "OFFBOARDED")]
    if dup_merchant:
        mrows.append(("A", dt.date(2000, 9, 1), "FRAUD", None, "OFFBOARDED"))
    m = merchants(spark, mrows)
    p = payments(spark, [
        (1, "A", ts(2000, 2, 1), 5.0, True, None, "success"),         # at case creation: out (H7)
        (2, "A", ts(2000, 2, 15), 100.0, True, 50.0, "success"),      # fraud and chargeback (H10)
        (3, "A", ts(2000, 9, 1), 7.0, None, 0.0, "success"),          # offboarding midnight: in; cb 0 (H11)
        (4, "A", ts(2000, 9, 1, 10), 9.0, True, None, "success"),     # later that day: out (H7)
        (5, "A", ts(2000, 3, 1), 11.0, True, None, "refused"),        # refused
        (6, "B", ts(2000, 3, 1), 13.0, True, None, "success"),        # merchant never offboarded (H6)
        (7, "A", ts(2000, 5, 1), 10.0, False, None, "success"),
    ])
    return c, m, p


def test_loss_hazards(spark):
    c, m, p = _loss_tables(spark)
    params = LossParams(as_of=AS_OF)
    rows = {r.rule_group: r for r in L.rule_loss(c, m, p, params).collect()}
    assert set(rows) == {"Bin6AttemptedVolumeSpike", "WithdrawalRule", "Transaction_amount"}
    b = rows["Bin6AttemptedVolumeSpike"]
    assert (b.unique_merchants, b.total_payments, b.nof_payments, b.nof_amount_gbp, b.chargeback_payments,
            b.chargeback_amount_gbp, b.problematic_merchants, b.total_fraud_gbp,
            b.avg_fraud_per_problematic_merchant) == (2, 3, 1, 100.0, 2, 50.0, 1, 150.0, 150.0)
    w = rows["WithdrawalRule"]
    assert (w.unique_merchants, w.total_payments, w.nof_payments, w.chargeback_payments,
            w.problematic_merchants, w.total_fraud_gbp, w.avg_fraud_per_problematic_merchant) == (1, 2, 0, 1, 1, 0.0, 0.0)
    t = rows["Transaction_amount"]
    assert (t.unique_merchants, t.total_payments, t.problematic_merchants) == (1, 0, 0)
    s = L.rule_loss_summary(c, m, p, params).collect()[0]
    assert (s.total_merchants, s.total_payments, s.total_fraud_gbp) == (4, 5, 150.0)
    assert s.monthly_avg_fraud_gbp == 150.0 / 6


def test_loss_literal_join_matches_and_salting(spark):
    c, m, p = _loss_tables(spark)
    params = LossParams(as_of=AS_OF)
    base = sorted(map(tuple, L.rule_loss(c, m, p, params).collect()))
    salted = sorted(map(tuple, L.rule_loss(c, m, p, params.with_(salt_buckets=4)).collect()))
    assert base == salted
    from reviewcap.operators.cases import first_case_per_profile_rule
    first = first_case_per_profile_rule(c, params)
    lit = L.post_case_payments_literal(first, m, p, params)
    assert lit.filter(F.col("card_attempt_id").isNotNull()).count() == 5
    assert lit.count() == 5 + 2  # B (no payment) and D (no merchant) keep one row each
    for salt in (1, 3):
        got = L.post_case_payments(first, m, p, params.with_(salt_buckets=salt))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, lit.collect()), key=str)


def test_h21_duplicate_merchants_fan_out(spark):
    c, m, p = _loss_tables(spark, dup_merchant=True)
    from reviewcap.operators.cases import first_case_per_profile_rule
    first = first_case_per_profile_rule(c, LossParams(as_of=AS_OF))
    lit = L.post_case_payments_literal(first, m, p, LossParams(as_of=AS_OF))
    got = L.post_case_payments(first, m, p, LossParams(as_of=AS_OF))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, lit.collect()), key=str)
    rows = {r.rule_group: r for r in L.rule_loss(c, m, p, LossParams(as_of=AS_OF)).collect()}
    assert rows["Bin6AttemptedVolumeSpike"].total_payments == 6
    assert rows["Bin6AttemptedVolumeSpike"].unique_merchants == 2
    assert [r.profile_id for r in duplicate_keys(m, "profile_id").collect()] == ["A"]


def test_empty_loss_gives_zero_summary(spark):
    c, m, p = _loss_tables(spark)
    s = L.rule_loss_summary(c.limit(0), m, p, LossParams(as_of=AS_OF)).collect()[0]
    assert (s.total_merchants, s.total_payments, s.total_fraud_gbp, s.monthly_avg_fraud_gbp) == (0, 0, 0.0, 0.0)


def _precision_tables(spark):
    LTV = "Rule fired - o_LTVHigherThresholdBreached_PauseMerchant"
    PROTON = "Rule fired - o_ProtonmailEmailDomain_PauseMerchant"
    created = ts(2000, 5, 1)
    crows = [
        (1, "1", created, ACQ, "CLOSED", BIN6),
        (2, "2", created, ACQ, "CLOSED", BIN6),
        (3, "3", created, ACQ, "OPEN", BIN6),
        (4, "1", created, ACQ, "CLOSED", BIN6),           # no ASSIGN (H17)
        (5, "3", created, ACQ, "CLOSED", WITHDRAWAL),     # no ASSIGN: group with zeros
        (6, "2", created, ACQ, "CLOSED", WITHDRAWAL),     # assigned on the as-of day: out (H13)
        (7, "4", created, ACQ, "CLOSED", BIN6),           # merchant status PENDING
        (8, "7", created, ACQ, "CLOSED", BIN6),           # excluded profile
        (9, "1", created, PF, "CLOSED", PROTON),          # other type: group only
        (11, "1", created, ACQ, "OPEN", LTV),             # deactivated by creation, no CLOSE/ASSIGN (H16)
    ]
    erows = [(i, "CASE_CREATION", created, "system") for (i, *_rest) in crows]
    for i in (1, 2, 3, 7, 8, 9):
        erows.append((i, "ASSIGN", ts(2000, 5, 2), "agent"))
    erows.append((6, "ASSIGN", ts(2000, 7, 1), "agent"))
    m = merchants(spark, [
        ("1", dt.date(2000, 6, 1), "FRAUD", "FRAUD", "OFFBOARDED"),
        ("2", dt.date(2000, 6, 1), "HIDDEN_ACCOUNT", None, "offboarded"),
        ("3", None, None, None, "onboarded"),
        ("4", dt.date(2000, 6, 1), "FRAUD", "FRAUD", "PENDING"),
        ("7", dt.date(2000, 6, 1), "FRAUD", "FRAUD", "OFFBOARDED"),
        (None, None, None, None, "ONBOARDED"),            # NULL id passes the exclusion (H20)
    ])
    return cases(spark, crows), events(spark, erows), m


def test_precision_hazards(spark):
    c, e, m = _precision_tables(spark)
    params = PrecisionParams(as_of=AS_OF, excluded_profiles=("7",))
    got = {r.rule_group: tuple(r)[1:] for r in P.rule_precision_pruned(m, c, e, params).collect()}
    assert got == {
        "BIN Spike": (3, 1, 1, 33.33),
        "Withdrawal Rule": (0, 0, 0, None),
        "Protonmail": (0, 0, 0, None),
        "Higher LTV rule": (0, 0, 1, None),
        "Transaction amount": (0, 0, 0, None),
    }
    req = spark.createDataFrame([], "payment_request_id long, psp_reference string")
    pay = payments(spark, [(1, "1", ts(2000, 5, 3), 1.0, None, None, "success")])
    lit = {r.rule_group: tuple(r)[1:] for r in P.rule_precision(req, pay, m, c, e, params).collect()}
    assert lit == got


def test_h18_assigned_actor_is_min_name(spark):
    c = cases(spark, [(1, "1", ts(2000, 5, 1), ACQ, "CLOSED", BIN6)])
    e = events(spark, [(1, "ASSIGN", ts(2000, 5, 2), "zed"), (1, "ASSIGN", ts(2000, 5, 3), "amy"),
                       (1, "CASE_CREATION", ts(2000, 5, 1), "system")])
    r = case_review_times(c, e).collect()[0]
    assert (r.assigned_actor, r.case_assigned_time, r.case_closed_time) == ("amy", ts(2000, 5, 2), None)


def test_h8_boundary_counting(spark):
    df = spark.createDataFrame([(ts(2000, 1, 1, 10, 0, 59), ts(2000, 1, 1, 10, 1, 1)),
                                (ts(2000, 1, 1, 10, 59, 59), ts(2000, 1, 1, 11, 0, 0)),
                                (ts(2000, 1, 1, 10, 1, 1), ts(2000, 1, 1, 10, 0, 59))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = df.select(boundary_diff("MINUTE", F.col("a"), F.col("b")).alias("m"),
                    boundary_diff("HOUR", F.col("a"), F.col("b")).alias("h")).collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 1), (-1, 0)]


def test_h9_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.375,), (1.005,)], "x double")
    # numpy: 2.675 * 100 is exactly 267.5 in doubles, so half-even gives 2.68; 1.005 * 100 < 100.5
    assert [r[0] for r in df.select(round2_half_even(F.col("x"))).collect()] == [0.12, 2.68, 0.38, 1.0]
    pairs = spark.createDataFrame([(59, 87), (1, 32), (0, 0), (1, 3), (2, 3)], "a long, n long")
    assert [r[0] for r in pairs.select(pct_half_up(F.col("a"), F.col("n"))).collect()] == [
        67.82, 3.13, None, 33.33, 66.67]


def _plan_rows(spark, rows, budget, locks=()):
    ri = rule_inputs(spark, [(n, 50.0, 50.0, c, a, t) for n, c, a, t in rows])
    params = DEFAULT_PLAN.with_(budget_weekly_hours=budget, locks=tuple(locks))
    zero = spark.createDataFrame([], "rule_group string, avg_fraud_per_problematic_merchant double")
    sc = S.priority_scores(S.attach_loss(ri, zero, LossParams()), params)
    asg = A.review_assignment(sc, params)
    return {r.rule_name: r for r in asg.collect()}, A.assignment_summary(asg, params).collect()[0]


def test_h26_skip_and_continue(spark):
    # Big rule first (highest volume score) does not fit; the small one after it still does.
    rows, s = _plan_rows(spark, [("big", 100, 120, "Standard"), ("small", 2, 20, "Standard")], budget=35.0)
    assert rows["big"].proposed_review_type == "Light"
    assert rows["small"].proposed_review_type == "Standard"
    assert s.feasible


def test_h27_h28_deep_and_locks(spark):
    rows, _ = _plan_rows(spark, [("deep", 10, 30, "Deep"), ("locked", 5, 40, "Standard"), ("light", 3, 9, "Light")],
                         budget=500.0, locks=[("locked", "Deep")])
    assert rows["deep"].proposed_review_type == "Deep"
    assert rows["locked"].proposed_review_type == "Deep" and rows["locked"].proposed_time_minutes == 200
    assert rows["light"].proposed_review_type == "Light" and rows["light"].proposed_time_minutes == 45


def test_h29_infeasible_budget_is_reported(spark):
    rows, s = _plan_rows(spark, [("a", 1000, 30, "Standard")], budget=21.0)
    assert rows["a"].proposed_review_type == "Light"
    assert not s.feasible and s.final_weekly_hours > 21.0


def test_h22_h23_h24_loss_lookup(spark):
    ri = rule_inputs(spark, [("Known", 50.0, 50.0, 1, 10, "Standard"), ("Missing", 50.0, 50.0, 1, 10, "Standard")])
    loss = spark.createDataFrame([("Known", 100.005), ("AbuserFlag", 7.0)],
                                 "rule_group string, avg_fraud_per_problematic_merchant double")
    got = {r.rule_name: (r.avg_fraud_volume_per_problematic_merchant,
                         r.monthly_avg_fraud_volume_per_problematic_merchant)
           for r in S.attach_loss(ri, loss, LossParams()).collect()}
    assert got == {"Known": (100.0, 100.0 / 6), "Missing": (0.0, 0.0)}
    assert [r.rule_group for r in S.unplanned_loss_rules(ri, loss).collect()] == ["AbuserFlag"]


def test_attach_loss_per_unit(spark):
    ri = spark.createDataFrame([("t1", "A", 1.0, 1.0, 1, 10, "Standard"), ("t2", "A", 1.0, 1.0, 1, 10, "Standard")],
                               "team string, rule_name string, rule_precision_l3m double, per_case_precision double, "
                               "avg_cases_per_month int, avg_handling_time_minutes int, current_review_type string")
    loss = spark.createDataFrame([("t1", "A", 60.0), ("t2", "A", 120.0)],
                                 "team string, rule_group string, avg_fraud_per_problematic_merchant double")
    got = {r.team: r.monthly_avg_fraud_volume_per_problematic_merchant
           for r in S.attach_loss(ri, loss, LossParams(), keys=("team",)).collect()}
    assert got == {"t1": 10.0, "t2": 20.0}


def test_spine_counts_equal_literal_spine(spark):
    from helpers import requests as reqs
    m = merchants(spark, [("1", None, None, None, "ONBOARDED"), ("1", None, None, None, "ONBOARDED"),
                          ("2", None, None, None, "OFFBOARDED"), (None, None, None, None, "ONBOARDED"),
                          ("3", None, None, None, "PENDING")])
    p = payments(spark, [(1, "1", ts(2000, 1, 1), 1.0, None, None, "success"),
                         (2, "1", ts(2000, 1, 2), 1.0, None, None, "success"),
                         (3, None, ts(2000, 1, 3), 1.0, None, None, "success"),
                         (4, "3", ts(2000, 1, 3), 1.0, None, None, "success")])
    r = reqs(spark, [(1, "p"), (1, "p"), (2, "x"), (9, "p")])
    params = PrecisionParams(as_of=AS_OF, excluded_profiles=())
    lit = P.request_payment_merchant_spine(r, p, m, params).groupBy(*P.MERCHANT_COLS).agg(
        F.count(F.lit(1)).alias("spine_rows"), F.count("r_payment_request_id").alias("request_rows"),
        F.count("card_attempt_id").alias("payment_rows"))
    got = sorted(map(tuple, P.spine_per_merchant(r, p, m, params).collect()), key=str)
    assert got == sorted(map(tuple, lit.collect()), key=str)
    assert {(x[0], x[5]) for x in got} == {("1", 6), ("2", 1), (None, 1)}


def test_loss_by_team_equals_per_team_runs(spark):
    c, m, p = _loss_tables(spark)
    c = c.withColumn("team", (F.col("id") % 2).cast("int"))
    params = LossParams(as_of=AS_OF)
    by_team = {(r.team, r.rule_group): tuple(r)[2:] for r in L.rule_loss(c, m, p, params, by=("team",)).collect()}
    single = {}
    for team in (0, 1):
        for r in L.rule_loss(c.filter(F.col("team") == team).drop("team"), m, p, params).collect():
            single[(team, r.rule_group)] = tuple(r)[1:]
    assert by_team == single


def test_precision_by_team_equals_per_team_runs(spark):
    c, e, m = _precision_tables(spark)
    c = c.withColumn("team", (F.col("id") % 2).cast("int"))
    params = PrecisionParams(as_of=AS_OF, excluded_profiles=("7",))

    def nonzero(rows, key):
        return {key(r): tuple(r)[-4:] for r in rows if any(tuple(r)[-4:-1])}

    by_team = nonzero(P.rule_precision_pruned(m, c, e, params, by=("team",)).collect(),
                      lambda r: (r.team, r.rule_group))
    single = {}
    for team in (0, 1):
        rows = P.rule_precision_pruned(m, c.filter(F.col("team") == team).drop("team"), e, params).collect()
        single.update(nonzero(rows, lambda r, t=team: (t, r.rule_group)))
    assert by_team == single and by_team


# --- Missing scores, NULL keys, many rules, validation ------------------------
def test_rule_without_score_is_visited_last(spark):
    from reviewcap.params import PlanParams
    ri = rule_inputs(spark, [("R1", None, 0.0, 10, 45, "Standard"), ("R2", 97.0, 0.0, 10, 45, "Standard")])
    params = PlanParams(budget_weekly_hours=28.5, locks=())
    loss = spark.createDataFrame([], "rule_group string, avg_fraud_per_problematic_merchant double")
    plan = A.review_assignment(S.priority_scores(S.attach_loss(ri, loss, LossParams()), params), params)
    got = {r.rule_name: r.proposed_review_type for r in plan.collect()}
    # Both at Light need 5 h of work; the budget has room for one Standard rule: the one with a score.
    assert got == {"R1": "Light", "R2": "Standard"}


def test_loss_by_null_team_keeps_its_money(spark):
    c = cases(spark, [(1, "a", ts(2000, 3, 1), ACQ, "CLOSED", WITHDRAWAL)]).withColumn("team", F.lit(None).cast("string"))
    m = merchants(spark, [("a", dt.date(2000, 6, 1), "FRAUD", None, "OFFBOARDED")])
    p = payments(spark, [(1, "a", ts(2000, 4, 1), 10, True, None, "success")])
    r = L.rule_loss(c, m, p, LossParams(as_of=AS_OF), by=("team",)).collect()
    assert [(x.team, x.unique_merchants, x.total_payments, x.nof_amount_gbp) for x in r] == [(None, 1, 1, 10.0)]
    ri = rule_inputs(spark, [("WithdrawalRule", 1.0, 1.0, 1, 1, "Light")]).withColumn("team", F.lit(None).cast("string"))
    loss = L.rule_loss(c, m, p, LossParams(as_of=AS_OF), by=("team",))
    name = loss.first().rule_group
    got = S.attach_loss(ri.withColumn("rule_name", F.lit(name)), loss, LossParams(window_months=12), keys=("team",)).first()
    assert got.avg_fraud_volume_per_problematic_merchant == 10.0
    assert got.monthly_avg_fraud_volume_per_problematic_merchant == 10.0 / 12


def test_precision_by_null_team_is_a_team(spark):
    params = PrecisionParams(as_of=AS_OF)
    c = cases(spark, [(1, "a", ts(2000, 5, 1), ACQ, "CLOSED", BIN6), (2, "b", ts(2000, 5, 1), ACQ, "CLOSED", BIN6)])
    c = c.withColumn("team", F.when(F.col("id") == 1, "t"))
    e = events(spark, [(i, "ASSIGN", ts(2000, 5, 2), "x") for i in (1, 2)])
    m = merchants(spark, [(x, dt.date(2000, 6, 1), "FRAUD", None, "OFFBOARDED") for x in ("a", "b", "no case")])
    got = P.rule_precision_pruned(m, c, e, params, by=("team",)).collect()
    assert sorted((str(r.team), r.profiles_flagged_by_risk_rules, r.precision_l3m) for r in got) == [
        ("None", 1, 100.0), ("t", 1, 100.0)]


def test_derived_precision_of_600_rules(spark):
    from reviewcap.catalog import Rule, RuleCatalog
    from reviewcap.operators.derive import derived_rule_inputs
    n = 600
    catalog = RuleCatalog(tuple(Rule(f"L{i:04}", f"%rule-{i:04}-%", (f"rule-{i:04}-x",), f"P{i:04}") for i in range(n)))
    c = cases(spark, [(i, f"m{i}", ts(2000, 5, 1), ACQ, "CLOSED", f"rule-{i:04}-x") for i in range(n)])
    e = events(spark, [(i, k, ts(2000, 5, 2), "x") for i in range(n) for k in ("ASSIGN", "CLOSE")])
    m = merchants(spark, [(f"m{i}", dt.date(2000, 6, 1) if i % 2 else None, "FRAUD", None, "OFFBOARDED") for i in range(n)])
    got = {r.rule_name: r.rule_precision_l3m for r in derived_rule_inputs(
        spark, c, e, m, LossParams(as_of=AS_OF), PrecisionParams(as_of=AS_OF), catalog).collect()}
    assert all(got[f"L{i:04}"] == (100.0 if i % 2 else 0.0) for i in range(n))


def test_unknown_review_types_fail(spark):
    from reviewcap.params import PlanParams
    from reviewcap.sources import validated_rule_inputs
    with pytest.raises(ValueError):
        PlanParams(locks=(("R", "Deeep"),))
    bad = rule_inputs(spark, [("R", 1.0, 1.0, 1, 1, "standard")])
    with pytest.raises(Exception, match="unknown review type"):
        validated_rule_inputs(bad).collect()
    params = PlanParams(locks=())
    loss = spark.createDataFrame([], "rule_group string, avg_fraud_per_problematic_merchant double")
    with pytest.raises(Exception, match="unknown review type"):
        A.review_assignment(S.priority_scores(S.attach_loss(bad, loss, LossParams()), params), params).collect()
    twice = rule_inputs(spark, [("R", 1.0, 1.0, 1, 1, "Light")] * 2)
    with pytest.raises(Exception, match="more than one row"):
        validated_rule_inputs(twice).collect()
    missing = rule_inputs(spark, [("R", 1.0, 1.0, None, 1, "Light")])
    with pytest.raises(Exception, match="no avg_cases_per_month"):
        validated_rule_inputs(missing).collect()
    fine = rule_inputs(spark, [("R", None, 1.0, 1, 1, "Light"), ("Q", 1.0, 1.0, 1, 1, "Deep")])
    assert validated_rule_inputs(fine).count() == 2


def test_catalog_round_trip(spark):
    from reviewcap.catalog import DEFAULT_CATALOG, catalog_frame, catalog_from_frame
    frame = catalog_frame(spark)
    assert catalog_from_frame(frame) == DEFAULT_CATALOG
    with pytest.raises(ValueError):
        catalog_from_frame(frame.filter("like_pattern IS NOT NULL"))


def test_as_of_none_is_today(spark):
    today = spark.sql("SELECT current_date() AS d").first().d
    day = dt.datetime.combine(today, dt.time()) - dt.timedelta(days=20)
    c = cases(spark, [(1, "a", day, ACQ, "CLOSED", WITHDRAWAL), (2, "b", day - dt.timedelta(days=400), ACQ, "CLOSED", WITHDRAWAL)])
    m = merchants(spark, [("a", today, "FRAUD", None, "OFFBOARDED")])
    p = payments(spark, [(1, "a", day + dt.timedelta(days=1), 10, True, None, "success")])
    open_, dated = (L.rule_loss(c, m, p, LossParams(as_of=x)).collect() for x in (None, today))
    assert open_ == dated and open_[0].unique_merchants == 1 and open_[0].total_payments == 1


def test_loss_trend_pairs_do_not_grow_with_dates(spark):
    from reviewcap.operators.derive import rule_loss_trend
    c = cases(spark, [(i, f"m{i}", ts(2000, 6, 15), ACQ, "CLOSED", WITHDRAWAL) for i in range(20)])
    m = merchants(spark, [(f"m{i}", dt.date(2000, 12, 1), "FRAUD", None, "OFFBOARDED") for i in range(20)])
    p = payments(spark, [(i * 10 + j, f"m{i}", ts(2000, 7, 1 + j), 1, True, None, "success") for i in range(20) for j in range(10)])

    def pairs(dates):
        df = rule_loss_trend(c, m, p, dates, LossParams(as_of=AS_OF, salt_buckets=1))
        assert df.count() == len(dates)
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        out = []

        def walk(node):
            if node.nodeName() == "AdaptiveSparkPlan":
                return walk(node.executedPlan())
            if node.nodeName().endswith("QueryStage"):
                return walk(node.plan())
            if "Join" in node.nodeName() and "attempt_time" in node.toString().split("\n")[0]:
                out.append(node.metrics().apply("numOutputRows").value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(df._jdf.queryExecution().executedPlan())
        return max(out)

    assert pairs([dt.date(2000, 7, 1)]) == pairs([dt.date(2000, k, 1) for k in (7, 8, 9, 10)]) == 200
