"""Stored layout: payments bucketed by (profile_id, _salt) are joined without a shuffle."""

import __spark_entry__ as E  # noqa: F401  (puts the repo on sys.path)
from conftest import SF001
from reviewcap.operators import loss as L
from reviewcap.params import FIXTURE_LOSS
from reviewcap.sources import fixture_tables
from reviewcap.sources.layout import store_review_tables


def test_bucketed_layout_same_result_no_payment_shuffle(spark):
    t = fixture_tables(spark, SF001)
    stored = store_review_tables(spark, t, "lay_", payment_buckets=4, salt_buckets=3)
    params = FIXTURE_LOSS.with_(salt_buckets=3)
    base = sorted(map(tuple, L.rule_loss(t.dd_case, t.merchants, t.payments, FIXTURE_LOSS).collect()))
    prev = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = L.rule_loss(stored.dd_case, stored.merchants, stored.payments, params)
        got = sorted(map(tuple, df.collect()))
        tree = _tree(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", prev)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == base
    path = _path_to(tree, "lay_payments")
    assert path, "payments scan not found"
    assert "Bucketed: true" in path[-1][1]
    # from the scan up to the join that consumes it, no shuffle
    above = []
    for name, _ in reversed(path[:-1]):
        if "Join" in name:
            break
        above.append(name)
    assert not any("Exchange" in n or "ShuffleQueryStage" in n for n in above), above


def _tree(node):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _tree(node.executedPlan())
    if name.endswith("QueryStage"):
        return (name, node.simpleString(100), [_tree(node.plan())])
    kids = node.children()
    return (name, node.simpleString(100), [_tree(kids.apply(i)) for i in range(kids.size())])


def _path_to(t, table):
    name, text, kids = t
    if name.startswith("Scan") and table in text:
        return [(name, text)]
    for k in kids:
        p = _path_to(k, table)
        if p:
            return [(name, text)] + p
    return None


def test_fixture_tables_fall_back_to_views(spark, monkeypatch):
    import reviewcap.sources.fixtures as fx

    def boom(*a, **k):
        raise ValueError("no shared folder")

    monkeypatch.setattr(fx, "ensure_checkpoint_dir", boom)
    t = fx.fixture_tables(spark, SF001)
    base = fx.fixture_views(spark, SF001)
    assert t.dd_case.count() == base.dd_case.count() == 4599


def test_other_failures_of_storing_are_not_hidden(spark, monkeypatch):
    import pytest
    import reviewcap.sources.fixtures as fx

    def boom(*a, **k):
        raise PermissionError("disk")

    monkeypatch.setattr(fx, "_source_key", boom)
    with pytest.raises(PermissionError):
        fx.fixture_tables(spark, SF001)


def test_write_result_and_cluster_conf(spark, tmp_path):
    from reviewcap.session import cluster_conf
    from reviewcap.sources.sinks import preview, write_result
    df = E.queries()["rule_loss"](spark, SF001)
    out = str(tmp_path / "loss")
    write_result(df, out, partition_by=("rule_group",))
    back = spark.read.parquet(out)
    assert back.count() == 18 and set(back.columns) == set(df.columns)
    assert "rule_group" in preview(df, 3)
    conf = cluster_conf(8000, largest_shuffle_tb=100)
    assert int(conf["spark.sql.shuffle.partitions"]) >= 3 * 8000
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_readme_usage_from_paths(spark, tmp_path):
    """The README's usage example, on parquet copies of the sf0.001 fixtures."""
    import datetime as dt

    from reviewcap.operators import assignment, loss, precision, scoring
    from reviewcap.params import LossParams, PlanParams, PrecisionParams
    from reviewcap.sources import ReviewTables, published_rule_inputs

    f = fixture_tables(spark, SF001)
    paths = {}
    for n in ("dd_case", "case_state_change", "merchants", "payments", "requests"):
        paths[n] = str(tmp_path / n)
        getattr(f, n).write.parquet(paths[n])
    t = ReviewTables.from_paths(spark, paths)
    as_of = dt.date(2000, 7, 1)
    by_rule = loss.rule_loss(t.dd_case, t.merchants, t.payments, LossParams(as_of=as_of))
    prec = precision.rule_precision_pruned(t.merchants, t.dd_case, t.case_state_change, PrecisionParams(as_of=as_of))
    pp = PlanParams(budget_weekly_hours=75)
    scored = scoring.priority_scores(scoring.attach_loss(published_rule_inputs(spark), by_rule, LossParams()), pp)
    plan = assignment.review_assignment(scored, pp)
    assert (by_rule.count(), prec.count(), plan.count()) == (18, 18, 17)
