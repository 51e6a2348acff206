"""The three rounding rules of the source analysis, made deterministic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2_half_even(x: Column) -> Column:
    """pandas/numpy ``round(x, 2)``: ``rint(x * 100) / 100`` on doubles.

    Equal to numpy bit for bit; DuckDB's ``round_even(x * 100, 0) / 100`` too.
    """
    return F.rint(x.cast("double") * F.lit(100.0)) / F.lit(100.0)


def floor_div(a: Column, b: Column) -> Column:
    """Exact floor division of two long columns (``b`` > 0)."""
    a = a.cast("long")
    b = b.cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def pct_half_up(num: Column, den: Column) -> Column:
    """SQL ``ROUND(num / den, 4) * 100`` computed exactly on integers (half up).

    ``((num * 20000 + den) div (2 * den)) / 100``; NULL when ``den`` is 0.
    A plain ``round(num / den, 4) * 100`` gives e.g. 67.82000000000001.
    """
    n = num.cast("long")
    d = den.cast("long")
    k = floor_div(n * F.lit(20000) + d, d * F.lit(2))
    return F.when(d > 0, k.cast("double") / F.lit(100.0))


def money_text(x: Column) -> Column:
    """Python ``f'£{x:,.2f}'`` on a double: thousands separators, 2 places."""
    return F.concat(F.lit("£"), F.format_number(x.cast("double"), 2))
