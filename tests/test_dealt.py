"""Plans per unit: the rules are dealt out by unit once, before they are collected."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from reviewcap.operators import assignment as A
from reviewcap.operators import scoring as S
from reviewcap.params import DEFAULT_PLAN, FIXTURE_LOSS
from reviewcap.plans import registry as R
from reviewcap.sources import load_rule_inputs, published_top5_loss, unit_portfolios
from reviewcap.sources.rule_inputs import PUBLISHED_RULE_INPUTS


def customers(spark, n):
    """Keys that repeat and a null one are units like others."""
    return spark.range(n).select(F.when(F.col("id") > 0, F.col("id") % (n - 3)).alias("c_custkey"))


def planned(spark, inputs):
    with_loss = S.attach_loss(inputs, published_top5_loss(spark), FIXTURE_LOSS)
    return A.review_assignment(S.priority_scores(with_loss, DEFAULT_PLAN, units=("unit",)), DEFAULT_PLAN, ("unit",))


def test_dealt_rows_are_planned_as_before(spark, monkeypatch):
    monkeypatch.setattr(S, "DEALT_ROWS", 100)
    few = customers(spark, 60)
    dealt = unit_portfolios(S.dealt_by_unit(few, ("c_custkey",), len(PUBLISHED_RULE_INPUTS)))
    assert dealt.rdd.getNumPartitions() == -(-60 * len(PUBLISHED_RULE_INPUTS) // 100)
    assert S.dealt_by_unit(few.limit(0), ("c_custkey",)).count() == 0
    columns = ["unit", "rule_name", "priority_score", "proposed_review_type", "proposed_time_hours"]
    want = planned(spark, unit_portfolios(few)).select(*columns).collect()
    got = planned(spark, dealt).select(*columns).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len(got) == 60 * len(PUBLISHED_RULE_INPUTS)


@pytest.mark.parametrize("name", ["priority_case", "capacity_comparison", "review_assignment_from_table"])
def test_rules_are_collected_after_the_exchange(spark, name):
    """Collecting before an exchange held all rows of a map task; a join by rule name dealt them out by 17 names."""
    plan = R.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rule_name" not in plan
    assert "collect_list" in plan and plan.rindex("collect_list") < plan.index("Exchange hashpartitioning(")  # the root comes first


def test_table_is_dealt_by_unit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "DEALT_ROWS", 100)
    unit_portfolios(spark.range(30).select(F.col("id").alias("c_custkey"))).write.parquet(f"{tmp_path}/t")
    read = load_rule_inputs(spark, f"{tmp_path}/t", ("unit",))
    assert read.rdd.getNumPartitions() == -(-30 * len(PUBLISHED_RULE_INPUTS) // 100)
    assert read.count() == 30 * len(PUBLISHED_RULE_INPUTS)
