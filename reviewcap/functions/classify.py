"""Rule classification of case metadata (first matching rule wins)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewcap.catalog import DEFAULT_CATALOG, RuleCatalog


def longest_literal(pattern: str) -> str:
    """The longest run of a LIKE pattern without wildcards (any match contains it)."""
    return max(re.split(r"[%_]", pattern), key=len)


def like_guarded(up: Column, pattern: str) -> Column:
    """``up LIKE pattern``, evaluated only where the pattern's longest literal occurs.

    Patterns with ``_`` stay regex matches in Spark (no LIKE simplification);
    the ``contains`` guard is a plain substring search and ``AND`` short-
    circuits, so most rows never reach the regex.  Same truth value.
    """
    lit = longest_literal(pattern)
    like = up.like(pattern)
    return up.contains(lit) & like if lit else like


def classify_contains(text: Column, catalog: RuleCatalog = DEFAULT_CATALOG) -> Column:
    """LOSS mode: ``upper(text) LIKE upper(pattern)``, in catalog order, else the fallback.

    Kept as LIKE (not ``contains``) because ``_`` in the patterns is a
    one-character wildcard.  NULL text falls through to the fallback label.
    """
    up = F.upper(text)
    expr = None
    for rule in catalog.rules:
        cond = like_guarded(up, rule.like_pattern.upper())
        expr = F.when(cond, F.lit(rule.loss_label)) if expr is None else expr.when(cond, F.lit(rule.loss_label))
    return expr.otherwise(F.lit(catalog.loss_else))


def classify_exact(text: Column, catalog: RuleCatalog = DEFAULT_CATALOG) -> Column:
    """PRECISION mode: case-insensitive equality with any of a rule's strings, else the fallback."""
    up = F.upper(text)
    expr = None
    for rule in catalog.rules:
        cond = up.isin([s.upper() for s in rule.exact_strings])
        label = F.lit(rule.precision_label)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(F.lit(catalog.precision_else))
