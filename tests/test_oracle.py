"""Every registered query equals its DuckDB oracle (rows, columns, exact values)."""

import pytest

import __spark_entry__ as E
from compare import compare
from conftest import SF001
from reviewcap.plans.registry import QUERIES, oracle_queries

NAMES = sorted(QUERIES)


def test_keys_match():
    assert set(QUERIES) == set(oracle_queries())
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_sf0001(spark, name):
    r = compare(E.queries()[name](spark, SF001), E.oracle_sql()[name], SF001)
    assert r["cols_match"], r["cols"]
    assert r["rows"][0] == r["rows"][1]
    assert r["hash_match"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 18
    assert df.columns[0] == "rule_group"
