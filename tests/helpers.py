"""Small hand tables for hazard tests."""

import datetime as dt
from decimal import Decimal

from reviewcap.sources.schemas import CASE_STATE_CHANGE, DD_CASE, MERCHANTS, PAYMENTS, REQUESTS, RULE_INPUTS

ACQ = "ACQUIRING_MERCHANT_REVIEW"
PF = "PAYFAC_DUE_DILIGENCE"
BIN6 = "Rule fired - o_Bin6AttemptedVolumeSpike_ReviewMerchant"
WITHDRAWAL = "Rule fired - o_WithdrawalRule_PauseMerchant"
AS_OF = dt.date(2000, 7, 1)


def ts(*a):
    return dt.datetime(*a)


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def cases(spark, rows):
    """rows: (id, profile, created, case_type, state, metadata)"""
    return spark.createDataFrame(rows, DD_CASE)


def events(spark, rows):
    return spark.createDataFrame(rows, CASE_STATE_CHANGE)


def merchants(spark, rows):
    """rows: (profile, date_offboarded, offboarding_reason, deactivation_reason, status)"""
    return spark.createDataFrame(rows, MERCHANTS)


def payments(spark, rows):
    """rows: (id, profile, time, amount, fraud, chargeback, flag) -> request id = id, psp = 'p'"""
    full = [(i, p, t, money(a), f, money(cb), flag, i, "p") for (i, p, t, a, f, cb, flag) in rows]
    return spark.createDataFrame(full, PAYMENTS)


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUESTS)


def rule_inputs(spark, rows):
    return spark.createDataFrame(rows, RULE_INPUTS)
