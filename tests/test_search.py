"""Single searches against plain loops over the candidates; many searches against single ones."""

import pytest
from pyspark.sql import functions as F

from ratecard.operators.search import search
from ratecard.operators.search_batch import search_many
from ratecard.plans.catalogue import _surface
from ratecard.sources.scratch import stored
from tests.conftest import SF

BRANDS = [f"Brand#{i}" for i in (1, 2, 12, 77)]


@pytest.fixture(scope="module")
def rows(spark):
    return stored(_surface(spark, SF).where("region = 'ASIA'"), "rows")


def attributes():
    return {"brand": F.col("brand"), "pack_size_kg": F.when(F.col("size") % 5 != 0, F.col("size"))}


def plain(offers, keep, relevance, match):
    """The published ranking of the offers that ``keep``, rolled up by product, by plain loops."""
    import math

    kept = [r for r in offers if keep(r)]
    prices = sorted(r.landed_minor for r in kept)
    scored = []
    for r in kept:
        cheaper = 0.0 if len(kept) == 1 else prices.index(r.landed_minor) / (len(kept) - 1)
        lead = 3 if r.lead_days is None else r.lead_days
        fit = match(r) if callable(match) else match
        total = 0.31 * relevance + 0.16 * fit + 0.16 * (1 - cheaper) + 0.10 * (0 if r.stock_state == "out_of_stock" else 0.5 if lead > 7 else 1) + 0.10 * 3.9 / 5 + 0.07 * 0.3 + 0.06 * math.exp(-lead / 7) + 0.04 * (1 - min(1, r.age_hours / r.sla_hours))
        total -= 0.25 * (r.freshness in ("STALE", "EXPIRED")) + 0.60 * (r.stock_state == "out_of_stock") + 0.35 * (r.moq > 1)
        scored.append(((-round(total, 6), r.landed_minor, -r.fetched_at.timestamp(), r.offer_key), r))
    scored.sort(key=lambda x: x[0])
    cards: dict = {}
    for i, (_, r) in enumerate(scored):
        best = cards.setdefault(r.product_id, [i, None])
        mine = (not r.quotable, r.landed_minor, i)
        if best[1] is None or mine < best[1][0]:
            best[1] = (mine, r.offer_key)
    return [(p, c[1][1]) for p, c in sorted(cards.items(), key=lambda x: x[1][0])][:24]


def shown(found):
    return [(r.product_id, r.offer_key) for r in found.results.collect()]


def test_one_list_of_all_categories(rows):
    offers = rows.collect()
    assert shown(search(rows, "brand#1 price", attributes(), brands=BRANDS)) == plain(offers, lambda r: r.brand == "Brand#1", 0.5, 1.0)
    both = search(rows, "anything", attributes(), brands=BRANDS)
    assert shown(both) == plain(offers, lambda r: True, 0.5, 0.5) and len({r.category for r in both.results.collect()}) > 1
    assert both.facet_category.count() == 0 or both.facet_category.first().category


def test_fallbacks(rows):
    offers = rows.collect()
    size = max(r.size for r in offers) + 1
    got = search(rows, f"brand#1 {size} kg", attributes(), brands=BRANDS)
    assert {r.rung for r in got.results.collect()} == {1}
    assert shown(got) == plain(offers, lambda r: r.brand == "Brand#1", 0.3, 0.3)
    gone = search(rows, f"brand#77 {size} kg", attributes(), brands=BRANDS)
    assert {r.rung for r in gone.results.collect()} == {2} and shown(gone) == plain(offers, lambda r: True, 0.3, 0.3)
    defs = {"size": (F.col("size"), ["Over 5000"])}
    alone = search(rows, "cement", attributes(), facet_defs=defs, selected={"size": ["Over 5000"]})
    cheapest = {r.offer_key for r in sorted((r for r in offers if r.category == "cement"), key=lambda r: (r.landed_minor, r.offer_key))[:24]}
    assert shown(alone) == plain(offers, lambda r: r.offer_key in cheapest, 0.2, 0.2) and {r.rung for r in alone.results.collect()} == {None}
    assert search(rows, "anything", attributes(), facet_defs=defs, selected={"size": ["Over 5000"]}).results.count() == 0  # no category to stand in
    assert search(rows, "nothing", attributes(), facet_defs=defs).facet_counts.count() == 0  # no category of most offers


def test_relevance_of_an_index(spark, rows):
    hits = rows.select("product_id").distinct().orderBy("product_id").limit(5).withColumn("relevance", F.lit(0.9))
    wanted = {r.product_id for r in hits.collect()}
    got = search(rows, "anything", attributes(), relevance=hits)
    assert shown(got) == plain(rows.collect(), lambda r: r.product_id in wanted, 0.9, 0.5)
    none = hits.where("product_id < 0")
    assert shown(search(rows, "anything", attributes(), relevance=none)) == plain(rows.collect(), lambda r: True, 0.0, 0.5)


def test_sorts_are_of_the_cards(rows):
    cards = search(rows, "anything", attributes(), page_size=500).results.collect()
    by_price = search(rows, "anything", attributes(), sort="price_low", page_size=500).results.collect()
    assert [r.product_id for r in by_price] == [r.product_id for r in sorted(cards, key=lambda r: (r.freshness == "EXPIRED", r.landed_minor, r.position))]
    prices = sorted(r.landed_minor for r in cards)
    value = lambda r: 0.5 * prices.index(r.landed_minor) / max(1, len(cards) - 1) - 0.3 * 3.5 / 5
    by_value = search(rows, "anything", attributes(), sort="best_value", page_size=500).results.collect()
    assert [r.product_id for r in by_value] == [r.product_id for r in sorted(cards, key=lambda r: (round(value(r), 9), r.position))]


def test_many_searches_equal_single_ones(spark, rows):
    texts = ["cement brand#1 7 kg", "cement brand#1 999 kg", "pipe brand#77", "brand#12 3 kg", "", None, "cement", "cement brand#1 7 kg", "opc 53 cement brand#2", "nothing such"]
    asked = spark.createDataFrame([(i, t, "ASIA") for i, t in enumerate(texts)] + [(90, "cement", "NOWHERE"), (91, "cement", None)], "query_id int, text string, region string")
    got: dict = {}
    for r in search_many(rows, asked, attributes(), BRANDS).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(((r.product_id, r.offer_key), r.rung))
    assert 90 not in got and 91 not in got
    for i, t in enumerate(texts):
        found = search(rows, t or "", attributes(), brands=BRANDS)
        assert [x for x, _ in got[i]] == shown(found), t
        assert {x for _, x in got[i]} == {r.rung for r in found.results.collect()}, t
    assert got[0] == got[7]


def test_column_sorts(spark, rows):
    from ratecard.operators import column_sorts

    assert len(column_sorts.REGISTRY) == 36
    cards = search(rows, "anything", attributes(), page_size=500).results.collect()
    for name, value in (("unit_price", lambda r: r.landed_minor), ("offers", lambda r: r.n_offers), ("eta", lambda r: r.lead_days), ("rating", lambda r: None)):
        for descending in (False, True):
            got = search(rows, "anything", attributes(), column=name, descending=descending, page_size=500)
            want = sorted(cards, key=lambda r: (value(r) is None, (-1 if descending else 1) * (value(r) or 0), r.position))
            assert [r.product_id for r in got.results.collect()] == [r.product_id for r in want], name
            assert "unknown values last" in got.disclosure
    texts = spark.createDataFrame([("b", 1), ("Á", 2), ("a", 3), (None, 4), ("", 5), ("B", 6), ("é", 7), ("f", 8)], "brand string, i int")
    order = lambda d: [r.i for r in texts.orderBy(*column_sorts.column_sort("brand", d, texts.columns, F.asc("i"))).collect()]
    assert order(False) == [3, 2, 1, 6, 7, 8, 4, 5] and order(True) == [8, 7, 1, 6, 2, 3, 4, 5]
    assert column_sorts.direction("brand", True) == "Z–A" and column_sorts.direction("verified", False) == "oldest first"
    with pytest.raises(ValueError):
        column_sorts.column_sort("colour", False, texts.columns)


def test_sellers_are_counted_once_for_all_sets(spark, rows):
    """Sellers are no part of what is dealt to sets: they are counted by region and product."""
    asked = spark.createDataFrame([(0, "cement brand#1", "ASIA"), (1, "cement", "ASIA")], "query_id int, text string, region string")
    df = search_many(rows, asked, attributes(), BRANDS)
    want = {r.product_id: (r.s, r.n) for r in rows.groupBy("product_id").agg(F.countDistinct("vendor_id").alias("s"), F.count("*").alias("n")).collect()}
    got = df.collect()
    assert {r.query_id for r in got} == {0, 1} and all((r.n_sellers, r.n_offers) == want[r.product_id] for r in got)
    dealt = df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [set")[1].split("Project [")[1].splitlines()[0]
    assert "landed_minor#" in dealt and "vendor_id#" not in dealt
