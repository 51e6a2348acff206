"""Plan-shape checks: no Python in the plan, no cartesian products, filters reach the scan."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from reviewcap.plans.registry import QUERIES

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_cartesian(spark, name):
    plan = plan_of(E.queries()[name](spark, SF001))
    for bad in FORBIDDEN:
        assert bad not in plan, (name, bad)


def test_loss_pushes_filters_to_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = plan_of(E.queries()["rule_loss"](spark, SF001))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(successful_transaction_flag), IsNotNull(attempt_time)" in plan
    assert "GreaterThan(attempt_time," in plan
    assert "GreaterThanOrEqual(time_created," in plan
    # column pruning: the case scan reads only what LOSS uses
    assert "ReadSchema: struct<reference_id:string,time_created:timestamp_ntz,case_type:string,state:string,metadata:string>" in plan


def test_precision_has_no_count_distinct_expand(spark):
    for name in ("rule_precision_pruned", "rule_loss"):
        plan = plan_of(E.queries()[name](spark, SF001))
        assert "Expand" not in plan, name


def _nodes(node, out):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _nodes(node.executedPlan(), out)
    if name.endswith("QueryStage"):
        return _nodes(node.plan(), out)
    out.append((name, node))
    kids = node.children()
    for i in range(kids.size()):
        _nodes(kids.apply(i), out)
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_windows_are_partitioned(spark, name):
    df = E.queries()[name](spark, SF001)
    windows = [node for n, node in _nodes(df._jdf.queryExecution().executedPlan(), []) if n == "Window"]
    assert all(w.partitionSpec().size() > 0 for w in windows), name
