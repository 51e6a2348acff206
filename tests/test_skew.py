"""A merchant with a third of the rows: AQE skew split and salting give exact results.

Checked against a brute-force Python restatement of LOSS on a small fixture.
"""

import datetime as dt
import random
import re
from collections import defaultdict

import pytest

from helpers import ACQ, AS_OF, BIN6, WITHDRAWAL, cases, merchants, payments, ts
from reviewcap.catalog import DEFAULT_CATALOG
from reviewcap.operators import loss as L
from reviewcap.params import LossParams

TEXTS = [BIN6, WITHDRAWAL, "note: " + WITHDRAWAL, "Rule fired - o_PayerDisputeThreshold_ReviewMerchant x", None]


def like(text, pattern):
    rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern.upper())
    return re.fullmatch(rx, text.upper(), re.S) is not None


def classify(text):
    if text is not None:
        for r in DEFAULT_CATALOG.rules:
            if like(text, r.like_pattern):
                return r.loss_label
    return DEFAULT_CATALOG.loss_else


def brute_loss(crows, mrows, prows, as_of):
    start = dt.datetime(as_of.year if as_of.month > 6 else as_of.year - 1, (as_of.month - 7) % 12 + 1, 1)
    first = {}
    for _id, prof, t, ctype, state, meta in crows:
        if t is None or t < start or ctype != ACQ or state != "CLOSED":
            continue
        k = (classify(meta), prof)
        first[k] = min(first.get(k, t), t)
    by_prof = defaultdict(list)
    for m in mrows:
        by_prof[m[0]].append(m)
    out = defaultdict(lambda: {"profiles": set(), "n": 0, "nof": 0, "nof_amt": 0.0, "cb": 0, "cb_amt": 0.0,
                               "prob": set()})
    for (rule, prof), created in first.items():
        o = out[rule]
        o["profiles"].add(prof)
        for m in by_prof.get(prof, []):
            if m[1] is None:
                continue
            cut = dt.datetime.combine(m[1], dt.time())
            for (_i, pp, t, amt, fraud, cb, flag) in prows:
                if pp == prof and flag == "success" and created < t <= cut:
                    o["n"] += 1
                    if fraud:
                        o["nof"] += 1
                        o["nof_amt"] += amt
                    if cb is not None:
                        o["cb"] += 1
                        o["cb_amt"] += cb
                    if fraud or cb is not None:
                        o["prob"].add(prof)
    return {r: (len(o["profiles"]), o["n"], o["nof"], round(o["nof_amt"], 2), o["cb"], round(o["cb_amt"], 2),
                len(o["prob"])) for r, o in out.items()}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(11)
    profs = [f"P{i}" for i in range(40)]
    crows, prows, cid, pid = [], [], 0, 0
    for _ in range(600):
        cid += 1
        prof = "HOT" if rng.random() < 0.3 else rng.choice(profs)
        crows.append((cid, prof, ts(2000, rng.randint(1, 8), rng.randint(1, 28)), ACQ,
                      rng.choice(["CLOSED", "CLOSED", "OPEN"]), rng.choice(TEXTS)))
    for _ in range(6000):
        pid += 1
        prof = "HOT" if rng.random() < 0.4 else rng.choice(profs)
        prows.append((pid, prof, ts(2000, rng.randint(1, 11), rng.randint(1, 28), rng.randint(0, 23)),
                      float(rng.randint(1, 50000)) / 100, rng.choice([True, False, False, None]),
                      rng.choice([None, None, None, 0.0, float(rng.randint(1, 9000)) / 100]),
                      rng.choice(["success", "success", "refused"])))
    mrows = [(p, rng.choice([None, dt.date(2000, 10, 15)]), None, None, "OFFBOARDED") for p in profs]
    mrows.append(("HOT", dt.date(2000, 11, 1), None, None, "OFFBOARDED"))
    return crows, mrows, prows


@pytest.mark.parametrize("salt", [1, 5])
def test_hot_merchant_loss_exact(spark, skewed, salt):
    crows, mrows, prows = skewed
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = L.rule_loss(cases(spark, crows), merchants(spark, mrows), payments(spark, prows),
                         LossParams(as_of=AS_OF, salt_buckets=salt))
        got = {r.rule_group: (r.unique_merchants, r.total_payments, r.nof_payments, round(r.nof_amount_gbp, 2),
                              r.chargeback_payments, round(r.chargeback_amount_gbp, 2), r.problematic_merchants)
               for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute_loss(crows, mrows, prows, AS_OF)
    if salt == 1:
        assert "skew=true" in plan  # AQE split the hot merchant's partition
