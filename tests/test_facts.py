"""Prefix sums, candidate cases, mergeable facts and published results against the forms they replace."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import ACQ, AS_OF, BIN6, PF, WITHDRAWAL, cases, events, merchants, payments, ts
from reviewcap.functions import classify_exact
from reviewcap.operators import cases as C
from reviewcap.operators import derive as D
from reviewcap.operators import facts as X
from reviewcap.operators import loss as L
from reviewcap.operators import precision as P
from reviewcap.params import FIXTURE_LOSS, FIXTURE_PRECISION, LossParams, PrecisionParams
from reviewcap.sources.sinks import publish_result, read_published

TEXTS = [BIN6, WITHDRAWAL, "note: " + WITHDRAWAL, "other", None]


def rows(df):
    return sorted(map(str, df.collect()))


def history(seed, n=400, first_year=1999):
    """Cases, events (some without a case, late, or before their case) and merchants (some repeated)."""
    r = random.Random(seed)

    def when():
        return ts(r.choice([first_year, 2000]), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59))

    c = [(i, r.choice(["HOT", "a", "b", "c", "d", None]), when(), r.choice([ACQ, ACQ, PF, "OTHER"]), r.choice(["CLOSED", "closed", "OPEN"]), r.choice(TEXTS)) for i in range(n)]
    e = [(r.randrange(n + 20), r.choice(["CASE_CREATION", "ASSIGN", "ASSIGN", "CLOSE"]), when(), r.choice(["x", "y", None])) for _ in range(2 * n)]
    m = [(p, r.choice([None, dt.date(2000, 9, 9)]), r.choice([None, "hidden_account", "FRAUD"]), r.choice([None, "FRAUD"]), r.choice(["OFFBOARDED", "onboarded", "PENDING", None]))
         for p in ("HOT", "a", "b", "c", "d", "no case", None, "a", "b")]
    return c + r.sample(c, 20), e, m


# --- LOSS by prefix sums --------------------------------------------------------
@pytest.mark.parametrize("per_day", [1, 6, 24])
def test_prefix_sums_equal_the_join(spark, per_day):
    """Ties of times, offboarding before the case, null and repeated merchants, a hot merchant."""
    r = random.Random(per_day)
    profs = ["HOT", "a", "b", "c", "never", "unknown", None]
    times = [ts(2000, 2, d, h) for d in (1, 2, 3) for h in (0, 0, 5, 23)] + [ts(2000, 8, 1), ts(1999, 1, 1), None]
    c = [(i, r.choice(profs), r.choice(times), ACQ, "CLOSED", r.choice(TEXTS)) for i in range(120)]
    p = [(None if i % 41 == 0 else i, "HOT" if r.random() < 0.4 else r.choice(profs), r.choice(times), r.choice([None, 0.01, 10.5, 99999.99]), r.choice([True, False, None]),
          r.choice([None, None, 0, 7.77]), r.choice(["success", "success", "refused"])) for i in range(900)]
    m = [("HOT", dt.date(2000, 2, 3), None, None, None), ("a", dt.date(2000, 2, 2), None, None, None), ("a", dt.date(2000, 9, 1), None, None, None), ("b", dt.date(1999, 1, 1), None, None, None),
         ("c", dt.date(2000, 2, 1), None, None, None), ("never", None, None, None, None), (None, dt.date(2000, 9, 1), None, None, None)]
    tables = cases(spark, c).withColumn("team", F.when(F.col("id") % 3 > 0, F.col("id") % 2)), merchants(spark, m), payments(spark, p)
    params = LossParams(as_of=AS_OF, buckets_per_day=per_day)
    for by in ((), ("team",)):
        df = L.rule_loss(*tables, params, by=by)
        assert rows(df) == rows(L.rule_loss(*tables, params.with_(salt_buckets=3), by=by))
    first = C.first_case_per_profile_rule(tables[0], params)
    literal = L.post_case_payments_literal(first, tables[1], tables[2], params).groupBy("rule_group").agg(F.count("card_attempt_id").alias("n"))
    assert {x.rule_group: x.n for x in literal.collect()} == {x.rule_group: x.total_payments for x in L.rule_loss(*tables, params).collect()}


def test_prefix_sums_have_no_range_join(spark):
    c, _, m = history(1)
    p = payments(spark, [(1, "a", ts(2000, 7, 1), 1, True, None, "success")])
    plan = L.rule_loss(cases(spark, c), merchants(spark, m), p, LossParams(as_of=AS_OF))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Join" in x and "attempt_time" in x]


# --- PRECISION by candidate cases --------------------------------------------------
def whole_history(spark, c, e, m, params, by=()):
    """PRECISION with the pivot of every event."""
    found = P.payfac_dd_cases(c, e, params, carry=by).withColumn("rule_group", classify_exact(F.col("rule_triggered")))
    return P._precision_from(m.filter(P.merchant_filter(params)), P.case_flags(found, params, by), P.DEFAULT_CATALOG, by, params.hidden_reason)


@pytest.mark.parametrize("seed", range(4))
def test_candidates_equal_the_whole_history(spark, seed):
    c, e, m = history(seed)
    c, e, m = cases(spark, c).withColumn("team", F.col("id") % 3), events(spark, e), merchants(spark, m)
    params = PrecisionParams(as_of=dt.date(2000, 5, 15), excluded_profiles=("c",))
    for by in ((), ("team",)):
        assert rows(P.rule_precision_pruned(m, c, e, params, by=by)) == rows(whole_history(spark, c, e, m, params, by))


def test_candidates_do_not_grow_with_the_history(spark):
    """Ten times the history outside the window: the same cases are pivoted, and the scan states the window."""
    c, e, m = history(5, first_year=2000)
    old_c = [(10_000 + i, p, t.replace(year=1990 + i % 9), k, s, x) for i, (_, p, t, k, s, x) in enumerate(c * 10)]
    old_e = [(10_000 + i, k, ts(1990 + i % 9, 3, 3), a) for i, (_, k, _, a) in enumerate(e * 10)]
    start, end = F.lit(dt.date(2000, 4, 1)), F.lit(dt.date(2000, 7, 1))

    def found(cs, es):
        return X.window_cases(cases(spark, cs), events(spark, es), start, end, (ACQ, PF))

    assert rows(found(c, e)) == rows(found(c + old_c, e + old_e))
    from conftest import SF001
    from reviewcap.sources import fixture_tables
    t = fixture_tables(spark, SF001)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = X.window_cases(t.dd_case, t.case_state_change, start, end, (ACQ, PF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(time_created,2000-04-01" in plan and "LessThan(time_created,2000-07-01" in plan


# --- facts -----------------------------------------------------------------------
def test_facts_by_month_add_up(spark, tmp_path):
    """Months written one by one, one of them again, give what one pass gives; a later month leaves the others alone."""
    c, e, m = history(7)
    c, e, m = cases(spark, c), events(spark, e), merchants(spark, m)
    loss, prec = FIXTURE_LOSS, FIXTURE_PRECISION
    whole = X.review_facts(c, e, *D.facts_span(loss, prec), loss, prec)
    cuts = [dt.date(2000, k, 1) for k in range(1, 8)]
    folder = str(tmp_path / "facts")
    for a, b in [*zip(cuts, cuts[1:]), (cuts[2], cuts[3])]:
        X.write_months(X.review_facts(c, e, F.lit(a), F.lit(b), loss, prec), folder)
    stored = X.read_months(spark, folder, cuts[0], cuts[-1])
    assert rows(stored.select(*whole.columns)) == rows(whole)
    inputs = D.rule_inputs_from_facts(spark, stored, m, loss, prec)
    assert rows(inputs) == rows(D.derived_rule_inputs(spark, c, e, m, loss, prec))
    one = X.read_months(spark, folder, dt.date(2000, 3, 1), dt.date(2000, 4, 1))
    assert {x.day.month for x in one.collect()} == {3}
    assert one.inputFiles() and "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


def test_derived_inputs_run_nothing_when_built(spark, monkeypatch):
    c, e, m = history(8)
    tables = cases(spark, c), events(spark, e), merchants(spark, m)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "built")
    try:
        D.derived_rule_inputs(spark, *tables, FIXTURE_LOSS, FIXTURE_PRECISION)
        assert list(tracker.getJobIdsForGroup("built")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("dates", [[dt.date(2000, 7, 1)], [dt.date(2000, k, 1) for k in (3, 4, 5, 6)], [dt.date(2000, 5, 31), dt.date(2000, 6, 17), dt.date(2000, 6, 18)]])
def test_trends_equal_each_date_alone(spark, dates):
    c, e, m = history(9)
    p = payments(spark, [(i, r, ts(2000, 1 + i % 9, 1 + i % 28), i, i % 3 == 0, None, "success") for i, r in enumerate(["HOT", "a", "b", "c", "d"] * 60)])
    c, e, m = cases(spark, c), events(spark, e), merchants(spark, m)
    got = D.rule_precision_trend(m, c, e, dates, PrecisionParams())
    want = []
    for d in dates:
        alone = whole_history(spark, c, e, m, PrecisionParams(as_of=d)).filter("profiles_flagged_by_risk_rules > 0")
        want += rows(alone.select(F.lit(d).alias("as_of"), "*"))
    assert rows(got) == sorted(want)
    loss = D.rule_loss_trend(c, m, p, dates, LossParams())
    want = [x for d in dates for x in rows(L.rule_loss(c, m, p, LossParams(as_of=d)).select(F.lit(d).alias("as_of"), "*"))]
    assert rows(loss) == sorted(want)


# --- published results -----------------------------------------------------------
def test_a_failed_writer_is_never_read(spark, tmp_path):
    folder = str(tmp_path / "result")
    publish_result(spark.range(3).withColumn("v", F.lit("first")), folder)
    bad = spark.range(10).withColumn("v", F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.lit("second")))
    with pytest.raises(Exception, match="lost"):
        publish_result(bad, folder)
    assert [x.v for x in read_published(spark, folder).collect()] == ["first"] * 3
    publish_result(spark.range(2).withColumn("v", F.lit("third")), folder)
    assert [x.v for x in read_published(spark, folder).collect()] == ["third"] * 2
