import pytest
from pyspark.sql import functions as F

from toolweave.llm import mix

PAIR = ["category", "domain"]


def tables(spark):
    rows = [(i, " A " if i % 3 == 0 else "a", "x") for i in range(600)] + [(i, "a", "y") for i in range(600, 640)] + [(i, "b", "x") for i in range(640, 645)]
    rows += [(900, None, "x"), (901, "", ""), (902, "zzz", "x"), (None, "a", "x"), (1, "a", "x")]
    tools = spark.createDataFrame(rows, "tool_id long, category string, domain string").withColumn("quota", F.lit("clash"))
    targets = spark.createDataFrame([("a", "x", 0.5, 3), ("a", "y", 0.4, 3), ("b", "x", 0.05, 4), ("b", "y", 0.05, 2)], "category string, domain string, target_share double, min_rows int")
    return tools, targets


def planned(spark):
    tools, targets = tables(spark)
    return tools, mix.plan(tools, "tool_id", PAIR, targets, "target_share", "min_rows", 0.2)


def test_availability(spark):
    tools, targets = tables(spark)
    state = mix.availability(tools, "tool_id", PAIR, targets, "target_share", "min_rows", 0.2)
    got = {(r.category, r.domain): (r.available, round(r.wanted, 6)) for r in state.collect()}
    assert got == {("a", "x"): (600, 64.5), ("a", "y"): (40, 51.6), ("b", "x"): (5, 6.45), ("b", "y"): (0, 6.45)}


def test_plan_and_draw(spark):
    tools, plan = planned(spark)
    rows = {(r.category, r.domain): r for r in plan.collect()}
    assert sum(r.quota for r in rows.values()) == 129
    assert rows["a", "y"].quota == 40 and rows["b", "x"].quota == 5 and rows["b", "y"].quota == 0 and rows["b", "y"].gap < 0
    drawn = mix.draw(tools, "tool_id", PAIR, plan)
    got = {tuple(r)[:2]: r.n for r in drawn.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: r.quota for k, r in rows.items() if r.quota}
    assert drawn.select("tool_id").distinct().count() == 129
    again = mix.draw(tools.repartition(5), "tool_id", PAIR, plan)
    assert sorted(r[0] for r in drawn.select("tool_id").collect()) == sorted(r[0] for r in again.select("tool_id").collect())


def test_draw_takes_the_least_keys(spark):
    tools, plan = planned(spark)
    drawn = {r.tool_id: r.rank_key for r in mix.draw(tools, "tool_id", PAIR, plan).where("category = 'a' AND domain = 'x'").collect()}
    everyone = {r.tool_id: r.rank_key for r in mix.draw(tools, "tool_id", PAIR, plan.withColumn("quota", F.lit(10_000))).where("category = 'a' AND domain = 'x'").collect()}
    assert sorted(drawn.values()) == sorted(everyone.values())[: len(drawn)]


def test_empty(spark):
    tools, targets = tables(spark)
    plan = mix.plan(tools.limit(0), "tool_id", PAIR, targets, "target_share", "min_rows", 0.2)
    assert [r.quota for r in plan.collect()] == [0] * 4
    assert mix.draw(tools.limit(0), "tool_id", PAIR, plan).count() == 0
    assert mix.plan(tools, "tool_id", PAIR, targets.limit(0), "target_share", "min_rows", 0.2).count() == 0


def test_rake_meets_margins():
    cells = mix.rake({("a", "x"): 60, ("a", "y"): 20, ("b", "x"): 5, ("b", "y"): 15}, [{"a": 0.5, "b": 0.5}, {"x": 0.3, "y": 0.7}])
    assert cells["a", "x"] + cells["a", "y"] == pytest.approx(0.5) and cells["a", "x"] + cells["b", "x"] == pytest.approx(0.3)


def test_quotas_keep_minimums():
    rows = [{"share": 0.9, "least": 0, "available": 1000}, {"share": 0.1, "least": 30, "available": 50}, {"share": 0.0, "least": 5, "available": 3}]
    assert mix.quotas(rows, 100) == [67, 30, 3]


def test_short_cells_are_made_up_for_in_their_margins(spark):
    """20 of (a, x)'s 40 are missing: (a, y) and (b, x) take them and (b, y) yields, so every label keeps its half."""
    have = {("a", "x"): 20, ("a", "y"): 200, ("b", "x"): 200, ("b", "y"): 80}
    rows = [(i, *cell) for i, cell in enumerate(c for c, n in have.items() for _ in range(n))]
    tools = spark.createDataFrame(rows, "tool_id long, category string, domain string")
    targets = spark.createDataFrame([("a", "x", 0.4, 0), ("a", "y", 0.1, 0), ("b", "x", 0.1, 0), ("b", "y", 0.4, 0)], "category string, domain string, target_share double, min_rows int")
    plan = mix.plan(tools, "tool_id", PAIR, targets, "target_share", "min_rows", 0.2)
    assert {(r.category, r.domain): r.quota for r in plan.collect()} == {("a", "x"): 20, ("a", "y"): 30, ("b", "x"): 30, ("b", "y"): 20}


def test_margins_are_within_a_row(spark):
    have = {(c, d): 300 for c in "abc" for d in "xyz"} | {("a", "x"): 10}
    rows = [(i, *cell) for i, cell in enumerate(c for c, n in have.items() for _ in range(n))]
    share = {(c, d): (0.2 if c == "a" else 0.1) / (1 if c == "a" else 1.5) for c in "abc" for d in "xyz"}
    whole = sum(share.values())
    targets = spark.createDataFrame([(*k, v / whole, 2) for k, v in share.items()], "category string, domain string, target_share double, min_rows int")
    plan = mix.plan(spark.createDataFrame(rows, "tool_id long, category string, domain string"), "tool_id", PAIR, targets, "target_share", "min_rows", 0.2)
    got = mix.margins(plan, PAIR).collect()
    assert len(got) == 6 and all(abs(r.gap) <= 1.5 for r in got)


def test_found_comes_from_the_plan(spark, sf, monkeypatch):
    from toolweave.llm import queries

    asked = []
    monkeypatch.setattr(mix, "plan", lambda *a, _plan=mix.plan: asked.append(a) or _plan(*a))
    queries.p5_found(spark, sf)
    assert asked
