"""Distributed selection against sorting, ties, negative values and one value over and over included."""

import math
import random

from ratecard.operators.selection import nearest_ranks, ranked_counts, selected_median
from ratecard.plans.selections import category_medians
from tests.conftest import SF


def test_against_sorting(spark):
    rng = random.Random(4)
    groups = {"one": [5], "two": [4, 7], "same": [3] * 500, "none": [None], "zero": [0, 0, -1, -2], None: [1, 2, 3, None]}
    groups |= {f"r{i}": [rng.choice((rng.randrange(50), rng.randrange(10**9), 10**15 + rng.randrange(9))) for _ in range(rng.randrange(1, 300))] for i in range(12)}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x long").selectExpr("*", "'n' as n", "1 as value")
    clean = {g: sorted(v for v in vs if v is not None) for g, vs in groups.items()}
    clean = {g: v for g, v in clean.items() if v}
    got = {r.g: r.median_minor for r in selected_median(rows, ["g"], "x").collect()}
    assert got == {g: (v[(len(v) - 1) // 2] + v[len(v) // 2] + 1) // 2 for g, v in clean.items()}
    ranks = {(r.g, r.p): r.value for r in nearest_ranks(rows, ["g"], "x", (0, 1, 50, 95, 100)).collect()}
    assert ranks == {(g, p): v[max(math.ceil(p * len(v) / 100) - 1, 0)] for g, v in clean.items() for p in (0, 1, 50, 95, 100)}
    counts = {(r.g, r.value): (r.n, r.before, r.total) for r in ranked_counts(rows, ["g"], "x").collect()}
    assert counts == {(g, x): (v.count(x), sum(y < x for y in v), len(v)) for g, v in clean.items() for x in v}


def test_no_group_is_one_task(spark):
    df = category_medians(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]
    assert "percentile" not in plan.lower() and "median" not in plan.lower().replace("median_minor", "")
    assert plan.count("ReusedExchange") >= 1
