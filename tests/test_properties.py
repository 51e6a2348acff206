"""Property tests: the per-unit fold equals a brute-force two-step greedy."""

import random

from pyspark.sql import functions as F

from reviewcap.operators import assignment as A
from reviewcap.operators import scoring as S
from reviewcap.params import DEFAULT_PLAN, REVIEW_TYPES, LossParams

LEVEL = {t: i for i, t in enumerate(REVIEW_TYPES)}


def weekly(minutes, p):
    return ((minutes / 60) + p.monthly_overhead_hours) * (p.months_per_year / p.weeks_per_year) + p.weekly_fixed_hours


def brute_force(rules, budget, locks, p):
    """Visit by score (desc, then name); try Standard then Deep under the ceiling, re-summing all rules."""
    order = sorted(rules, key=lambda r: (-r["score"], r["name"]))
    prop = {r["name"]: locks.get(r["name"], "Light") for r in order}

    def total():
        return sum(r["cases"] * (p.light_minutes if prop[r["name"]] == "Light" else r["aht"]) for r in order)

    for r in order:
        if r["name"] in locks:
            continue
        for target in ("Standard", "Deep"):
            cur = prop[r["name"]]
            if LEVEL[target] <= LEVEL[cur] or LEVEL[target] > LEVEL.get(r["current"], 0):
                continue
            prop[r["name"]] = target
            if weekly(total(), p) > budget:
                prop[r["name"]] = cur
                break
    return prop, total()


def test_fold_equals_two_step_greedy(spark):
    rng = random.Random(7)
    p = DEFAULT_PLAN.with_(locks=(("r0", "Deep"), ("r3", "Light"), ("r5", "Standard")))
    locks = dict(p.locks)
    units, rows = {}, []
    for u in range(400):
        n = rng.randint(1, 14)
        budget = float(rng.randint(20, 160))
        rules = []
        for k in range(n):
            r = {"name": f"r{k}", "cases": rng.randint(0, 120), "aht": rng.randint(1, 90),
                 "current": rng.choice(REVIEW_TYPES),
                 "score": float(rng.choice([rng.randint(0, 3000) / 100, 10.0]))}  # deliberate ties
            rules.append(r)
            rows.append((u, budget, r["name"], r["cases"], r["aht"], r["current"], r["score"]))
        units[u] = (rules, budget)
    df = spark.createDataFrame(rows, "unit int, budget_weekly_hours double, rule_name string, "
                                     "avg_cases_per_month int, avg_handling_time_minutes int, "
                                     "current_review_type string, priority_score double")
    asg = A.review_assignment(df, p, ("unit",))
    got = {(r.unit, r.rule_name): r.proposed_review_type for r in asg.collect()}
    summ = {r.unit: r for r in A.assignment_summary(asg, p, ("unit",)).collect()}
    infeasible = 0
    for u, (rules, budget) in units.items():
        prop, minutes = brute_force(rules, budget, locks, p)
        for name, t in prop.items():
            assert got[(u, name)] == t, (u, name)
        assert summ[u].final_total_minutes == minutes
        base = sum(r["cases"] * (r["aht"] if locks.get(r["name"], "Light") != "Light" else p.light_minutes)
                   for r in rules)
        # Never above max(starting hours, budget); proposed <= current unless locked.
        assert summ[u].final_weekly_hours <= max(weekly(base, p), budget) + 1e-9
        infeasible += not summ[u].feasible
        for r in rules:
            if r["name"] not in locks:
                assert LEVEL[got[(u, r["name"])]] <= LEVEL[r["current"]]
    assert 0 < infeasible < len(units)


def test_many_units_fixture_counts(spark):
    """FIXTURES.md "Many units": fixed published-5/L3M scores, 1,500 units at sf0.01."""
    from conftest import SF01
    from reviewcap.sources import fixture_customers, published_rule_inputs, published_top5_loss, unit_portfolios
    p = DEFAULT_PLAN
    scores = S.priority_scores(S.attach_loss(published_rule_inputs(spark), published_top5_loss(spark), LossParams()), p)
    units = unit_portfolios(fixture_customers(spark, SF01)).join(
        F.broadcast(scores.select("rule_name", "priority_score")), "rule_name")
    asg = A.review_assignment(units, p, ("unit",))
    summ = A.assignment_summary(asg, p, ("unit",))
    assert summ.count() == 1500
    assert summ.filter(~F.col("feasible")).count() == 432
    upgrades = (asg.filter(F.col("proposed_review_type") != "Light").groupBy("unit")
                .agg(F.array_sort(F.collect_list("rule_name")).alias("s")))
    assert upgrades.select("s").distinct().count() == 111


def test_guarded_like_equals_plain_like(spark):
    from reviewcap.catalog import DEFAULT_CATALOG
    from reviewcap.functions.classify import like_guarded
    rng = random.Random(3)
    base = [s for r in DEFAULT_CATALOG.rules for s in r.exact_strings]
    texts = [None, "", "Amount over limit"]
    for _ in range(3000):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):  # mutate: replace, drop or insert a character
            i = rng.randrange(len(t))
            op = rng.random()
            if op < 0.4:
                t[i] = rng.choice("_xO- ")
            elif op < 0.7:
                del t[i]
            else:
                t.insert(i, rng.choice("ab_%"))
        s = "".join(t)
        texts.append(rng.choice([s, "pre " + s, s + " post", s.lower()]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    up = F.upper(F.col("m"))
    cols = []
    for k, r in enumerate(DEFAULT_CATALOG.rules):
        p = r.like_pattern.upper()
        cols.append((like_guarded(up, p).eqNullSafe(up.like(p))).alias(f"c{k}"))
    row = df.select(*[F.min(c.cast("int")).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    assert all(v == 1 for v in row)
