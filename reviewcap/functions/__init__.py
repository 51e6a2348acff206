"""Column-expression helpers: everything here stays inside whole-stage codegen."""

from reviewcap.functions.classify import classify_contains, classify_exact
from reviewcap.functions.predicates import (
    half_open_window,
    not_equal_keep_null,
    problematic_payment,
    upper_eq,
)
from reviewcap.functions.rounding import money_text, pct_half_up, round2_half_even
from reviewcap.functions.timediff import boundary_diff

__all__ = [
    "boundary_diff",
    "classify_contains",
    "classify_exact",
    "half_open_window",
    "money_text",
    "not_equal_keep_null",
    "pct_half_up",
    "problematic_payment",
    "round2_half_even",
    "upper_eq",
]
