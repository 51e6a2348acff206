"""Inputs: warehouse tables, fixture views over the driver tables, planning inputs."""

from reviewcap.sources.fixtures import fixture_customers, fixture_tables, fixture_views
from reviewcap.sources.rule_inputs import (load_rule_inputs, published_rule_inputs, published_top5_loss,
                                           unit_portfolios, validated_rule_inputs)
from reviewcap.sources.schemas import assert_unique, conform, duplicate_keys, lower_columns
from reviewcap.sources.tables import ReviewTables

__all__ = [
    "ReviewTables",
    "assert_unique",
    "conform",
    "duplicate_keys",
    "fixture_customers",
    "fixture_tables",
    "fixture_views",
    "load_rule_inputs",
    "lower_columns",
    "published_rule_inputs",
    "published_top5_loss",
    "unit_portfolios",
    "validated_rule_inputs",
]
