"""Golden scalars of the functions, each through Spark."""

import datetime

import pytest
from pyspark.sql import functions as F

from ratecard.functions import freight, freshness, money, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


L = F.lit


def test_money(spark):
    assert [one(spark, money.half_up(L(x))) for x in (2.5, -2.5, 2.4999)] == [3, -2, 2]
    assert one(spark, money.tax_on(L(40200), L(1800))) == 7236
    assert one(spark, money.base_of_inclusive(L(47436), L(1800))) == 40200
    texts = {"7.30": 730, "1,250": 125000, "Rs 8.05": 805, "₹ 8.70": 870, "7.305": None, "Ask Price": None, "Rs. 12": 1200, "": None}
    assert {t: one(spark, money.minor_from_rupee_text(L(t))) for t in texts} == texts
    shown = {123: "₹1.23", 100000: "₹1,000.00", 123456789: "₹12,34,567.89", -5: "-₹0.05", 10000000000: "₹10,00,00,000.00"}
    assert {m: one(spark, money.format_minor(L(m))) for m in shown} == shown
    assert [one(spark, money.compact_minor(L(m))) for m in (12_50_000_00, 3_40_00_000_00, 5_600_00, 950_00)] == ["₹12.50L", "₹3.40Cr", "₹5.6k", "₹950"]
    median = lambda xs: spark.createDataFrame([(x,) for x in xs], "x long").select(money.median_minor(F.col("x")).alias("m")).first().m
    assert [median(x) for x in ([10, 13], [5], [], [1, 2, 9])] == [12, 5, 0, 2]
    assert [one(spark, money.clamp_quantity(L(q), L(m).cast("int"))) for q, m in ((0.2, 5), (7.5, 1), (99999.0, 1), (3.0, None))] == [5, 8, 9999, 3]
    assert one(spark, money.tax_inside(L(11800), L(1800))) == 1800


def test_units(spark):
    bores = {'1"': 25, '½"': 15, '¾"': 20, '4"': 110, '1½"': 40, '1¼"': 32, "1 1/2 inch": 40, "0.5 in": 15, '7"': None}
    assert {t: one(spark, units.bore_mm(L(t))) for t in bores} == bores
    assert one(spark, units.inches_of(L(25))) == "1"
    assert [one(spark, units.bar_kg_per_m(L(float(d)))) for d in (8, 12, 12.4, 14)] == [0.395, 0.888, 0.888, None]
    assert one(spark, units.rod_kg(L(12.0), L(12.0))) == pytest.approx(10.656)
    forms = {"Per piece": "piece", "perkg": "kg", "Brick": "piece", "/Bag": "bag", "8000 pieces": None, "Feet": "running_metre", "Nos": "piece", "sq ft": "sqft", "Thousand": "per_1000", "": None, "Quintal": "quintal", "bag of 50": "bag"}
    assert {t: one(spark, units.normalise_unit(L(t)).unit) for t in forms} == forms
    assert one(spark, units.normalise_unit(L("ft")).factor) == pytest.approx(3.28084)
    price = lambda a, u, p: one(spark, units.cement_bag_price(L(a), L(u), L(p).cast("double")))
    assert [price(700, "kg", None), price(700000, "tonne", None), price(15000, "bag", 25.0), price(1, "coil", None)] == [35000, 35000, 30000, None]
    assert one(spark, units.number_in(L("about -1,234.5 kg"))) == -1234.5
    assert one(spark, units.normal_query(L("  25MM  CPVC “Pipe” 2×4"))) == '25 mm cpvc "pipe" 2x4'
    assert one(spark, units.entities_decoded(L("a &amp;lt; b"))) == "a &lt; b"
    assert one(spark, units.short_id("p_", L("abc"))) == "p_a9993e364706816a"


def test_freight(spark):
    assert one(spark, freight.fnv1a(L("v_abc123"))) == 1003000610
    assert one(spark, freight.fallback_km(L("v_abc123"))) == 38.77
    assert one(spark, freight.haversine_km(L(0.0), L(0.0), L(0.0), L(1.0))) == pytest.approx(111.195, abs=1e-3)
    d = freight.delivery(L(20.0), L("cement"), L(50.0), L(50), order_value=L(100), free_from=L(200))
    row = spark.range(1).select(d.chargeable_kg.alias("kg"), d.vehicle.alias("v"), d.trips.alias("t"), d.trip_cost.alias("c"), d.freight.alias("f"), d.handling.alias("h"), d.loading.alias("l"), d.basis.alias("b"), d.breakdown.alias("steps")).first()
    assert (row.kg, row.v, row.t, row.c, row.f, row.h, row.l, row.b) == (2500.0, "lcv", 1, 90000, 1800, 1250, 200, "computed") and len(row.steps) == 9
    free = freight.delivery(L(20.0), L("cement"), L(50.0), L(50), order_value=L(300), free_from=L(200))
    assert (one(spark, free.freight), one(spark, free.basis)) == (0, "free_delivery")
    own = freight.delivery(L(20.0), L("cement"), L(50.0), L(50), published=L(777).cast("bigint"))
    assert (one(spark, own.freight), one(spark, own.basis)) == (777, "vendor_published")
    parcel = freight.delivery(L(20.0), L("water_pipes"), L(0.42), L(20))
    assert (one(spark, parcel.vehicle), one(spark, parcel.trip_cost)) == ("parcel", 8000 + 5040)
    bulky = freight.delivery(L(20.0), L("bricks_blocks"), L(3.1), L(10_000), unit_m3=L(0.5))
    assert one(spark, bulky.trips) == 79
    assert [one(spark, freight.distance_band(L(x))) for x in (15.0, 15.1, 100.0, 250.5)] == ["local", "metro", "regional", "long_haul"]


def test_freshness(spark):
    states = [one(spark, freshness.freshness_state(L(float(h)), L(24))) for h in (6, 18, 40, 80)]
    assert states == ["FRESH", "AGEING", "STALE", "EXPIRED"]
    assert one(spark, freshness.stale_penalty(L("STALE"))) == 0.25 and not one(spark, freshness.quotable(L("EXPIRED")))
    assert one(spark, freshness.sla_hours(L("water_pipes"))) == 168
    at = lambda d: L(datetime.datetime(2024, 1, d)).cast("timestamp")
    assert one(spark, freshness.age_hours(at(1), at(3))) == 48.0
    assert one(spark, freshness.humanise(L(30.0))) == "1 d ago" and one(spark, freshness.dot(L(30.0))) == "amber"
