"""Places and neighbours in groups of any size, against plain sorting."""

import random

from pyspark.sql import functions as F

from ratecard.operators import ranking
from ratecard.plans.catalogue import QUERIES
from tests.conftest import SF


def test_places_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(g, rng.choice((1, 1, 1, rng.randrange(9), None)), i) for g, size in (("hot", 700), ("b", 40), ("c", 1), (None, 5)) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    order = [F.desc_nulls_last("x"), F.asc("i")]
    placed = ranking.placed(df.where("g is not null"), ["g"], order)
    got = {(r.g, r.i): (r.place, r.near) for r in ranking.neighbours(placed, ["g"], "place", 3, F.col("i"), "near").collect()}
    for g in ("hot", "b", "c"):
        own = [i for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))]
        for at, i in enumerate(own):
            near = [own[k] for d in (1, 2, 3) for k in (at - d, at + d) if 0 <= k < len(own)]
            assert got[g, i] == (at + 1, near)
    assert len(got) == sum(r[0] is not None for r in rows)


def test_no_window_over_a_whole_group(spark):
    for name in ("substitutes", "sort_nulls_last_asc", "quality_rank"):
        df = QUERIES[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]
        for line in plan.splitlines():
            if "Window [" in line and "row_number" in line or "lag(" in line:
                assert "_band" in line or "_block" in line, (name, line[:200])


def test_offers_are_read_and_shuffled_once_for_ranks(spark):
    """The sizes of bands come from the rows' own exchange; an exchange that is used again shows no scan below it."""
    for name, exchanges in (("rank_score", 1), ("group_by_product", 2)):
        df = QUERIES[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]
        assert plan.count("lineitem.parquet") == 1, name
        assert plan.count("ReusedExchange") >= exchanges, name
