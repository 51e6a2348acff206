"""Parameters of the three programs, as frozen dataclasses.

Every window is anchored on an explicit ``as_of`` date; ``None`` means
``current_date()`` at run time, which is what the source analysis does.
Tests and registered queries always pass a date.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

ACQUIRING = "ACQUIRING_MERCHANT_REVIEW"
PAYFAC_DD = "PAYFAC_DUE_DILIGENCE"

REVIEW_TYPES = ("Light", "Standard", "Deep")  # ordered: level 0 < 1 < 2


def as_of_col(as_of: dt.date | Column | str | None) -> Column:
    """The as-of date as a Column: a literal date, a column (per-row as-of), or today."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.col(as_of)
    return F.lit(as_of)


@dataclass(frozen=True)
class LossParams:
    as_of: dt.date | None = None
    window_months: int = 6
    case_type: str = ACQUIRING
    closed_state: str = "CLOSED"
    success_flag: str = "success"
    # None: loss by prefix sums over time buckets, this many of them a day.
    # A number: by a range join in which each profile's payments are spread
    # over this many join keys, and the (small) case side is copied to each; 1
    # turns salting off.
    salt_buckets: int | None = None
    buckets_per_day: int = 1

    def with_(self, **kw) -> "LossParams":
        return replace(self, **kw)


@dataclass(frozen=True)
class PrecisionParams:
    as_of: dt.date | None = None
    window_months: int = 3
    case_types: tuple[str, ...] = (ACQUIRING, PAYFAC_DD)
    flag_case_type: str = ACQUIRING
    closed_state: str = "CLOSED"
    hidden_reason: str = "hidden_account"
    # Profiles left out of the precision spine (none by default; test accounts, say).
    excluded_profiles: tuple[str, ...] = ()
    # The two accepted onboarding statuses (compared case-insensitively).
    statuses: tuple[str, ...] = ("OFFBOARDED", "ONBOARDED")

    def with_(self, **kw) -> "PrecisionParams":
        return replace(self, **kw)


@dataclass(frozen=True)
class PlanParams:
    # Fixed values of the planning sheet: weekly budget, locked rules, score
    # weights (loss, precision, volume), light-review minutes, monthly
    # overhead hours, weekly fixed NOF/chargeback hours, months and weeks per
    # year.  The months a loss covers are those of its LossParams.
    budget_weekly_hours: float = 75.0
    locks: tuple[tuple[str, str], ...] = (("LTVHigherThresholdBreached", "Deep"),)
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    light_minutes: int = 15
    monthly_overhead_hours: float = 24.8
    weekly_fixed_hours: float = 20.0
    months_per_year: int = 12
    weeks_per_year: int = 52
    precision_col: str = "rule_precision_l3m"

    def __post_init__(self) -> None:
        unknown = [t for _, t in self.locks if t not in REVIEW_TYPES]
        if unknown:
            raise ValueError(f"unknown review type in locks: {unknown[0]!r}")
        if len({r for r, _ in self.locks}) < len(self.locks):
            raise ValueError("a rule is locked more than once")

    def with_(self, **kw) -> "PlanParams":
        return replace(self, **kw)


# Parameters of the fixture views built over the driver tables (FIXTURES.md).
FIXTURE_AS_OF = dt.date(2000, 7, 1)
FIXTURE_LOSS = LossParams(as_of=FIXTURE_AS_OF)
FIXTURE_PRECISION = PrecisionParams(as_of=FIXTURE_AS_OF, excluded_profiles=("7", "8"))
DEFAULT_PLAN = PlanParams()
