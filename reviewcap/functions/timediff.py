"""Boundary-counting date differences (warehouse ``DATEDIFF`` semantics)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boundary counts are differences of whole units elapsed since an anchor on a
# day boundary before all data (0001-01-01, built as timestamp_ntz so no time
# zone is involved), so they never truncate toward zero.


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end`` (signed).

    10:00:59 -> 10:01:01 is 1 minute here (Spark's ``timestamp_diff`` alone
    says 0).  ``unit`` is ``MINUTE`` or ``HOUR`` (or any fixed-length unit).
    """
    one, zero = F.lit(1), F.lit(0)
    anchor = F.make_timestamp_ntz(one, one, one, zero, zero, zero)
    u = unit.upper()
    return F.timestamp_diff(u, anchor, end) - F.timestamp_diff(u, anchor, start)
