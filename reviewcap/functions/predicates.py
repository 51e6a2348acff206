"""Named predicates that the programs repeat; one definition each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_open_window(t: Column, as_of: Column, months: int) -> Column:
    """``t >= add_months(as_of, -months) AND t < as_of``."""
    return (t >= F.add_months(as_of, -months)) & (t < as_of)


def upper_eq(c: Column, value: str) -> Column:
    """Case-insensitive equality with a literal (``UPPER(c) = UPPER(v)``)."""
    return F.upper(c) == F.lit(value.upper())


def not_equal_keep_null(c: Column, value: str) -> Column:
    """``UPPER(c) <> UPPER(v) OR c IS NULL``."""
    return (F.upper(c) != F.lit(value.upper())) | c.isNull()


def not_in_keep_null(c: Column, values: Iterable[str]) -> Column:
    """``UPPER(c) <> v1 AND ... OR c IS NULL`` (AND binds before OR)."""
    vals = [v.upper() for v in values]
    if not vals:
        return F.lit(True)
    return (~F.upper(c).isin(vals)) | c.isNull()


def problematic_payment(fraud_flag: Column, chargeback: Column) -> Column:
    """A payment with a chargeback (even of 0) or a fraud flag; NULL flag counts as not fraud."""
    return chargeback.isNotNull() | F.coalesce(fraud_flag, F.lit(False))
