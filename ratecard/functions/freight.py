"""Distances, vehicles and delivery costs: Column functions over minor units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import half_up

#: Vehicles (class, most kg, minor units a km, least a trip), the parcel tariff, bands, logistics.
VEHICLES = (("parcel", 50, 0, 8_000), ("tempo", 1_500, 2_400, 45_000), ("lcv", 3_500, 3_000, 90_000), ("6_tyre", 9_000, 3_800, 160_000), ("10_tyre", 16_000, 5_200, 300_000))
PARCEL_BASE, PARCEL_PER_KG = 8_000, 600
BANDS = ((15, "local"), (40, "metro"), (100, "regional"), (250, "inter_city"))
CIRCUITY, EARTH_KM, VOLUMETRIC = 1.32, 6371.0, 250
#: category: loading a unit, handling a kg, least handling, reference quantity.
LOGISTICS = {"cement": (200, 25, 4_000, 50), "tmt_steel": (30, 20, 5_000, 1_000), "water_pipes": (300, 40, 3_000, 20), "bricks_blocks": (35, 15, 4_000, 1_000)}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def two_places(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def road_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return two_places(haversine_km(lat1, lon1, lat2, lon2) * CIRCUITY)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters, as a BIGINT."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(2_166_136_261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16_777_619)).bitwiseAND(F.lit(4_294_967_295)))


def fallback_km(vendor_id: Column) -> Column:
    """6.00 to 42.00 km, the same for a vendor at any time."""
    return two_places(6 + (fnv1a(vendor_id) % 3601) / 100)


def distance_band(km: Column) -> Column:
    out = F.lit("long_haul")
    for most, name in reversed(BANDS):
        out = F.when(km <= most, F.lit(name)).otherwise(out)
    return out


def _vehicle(kg: Column, place: int) -> Column:
    out = F.lit(VEHICLES[-1][place])
    for v in reversed(VEHICLES[:-1]):
        out = F.when(kg <= v[1], F.lit(v[place])).otherwise(out)
    return out


def vehicle_class(kg: Column) -> Column:
    return _vehicle(kg, 0)


def logistics(category: Column, place: int) -> Column:
    """0 loading, 1 handling a kg, 2 least handling, 3 reference quantity; cement's for other categories."""
    out = F.lit(LOGISTICS["cement"][place])
    for name, row in LOGISTICS.items():
        out = F.when(category == name, F.lit(row[place])).otherwise(out)
    return out


def lead_days(band: Column, published: Column | None = None) -> Column:
    modelled = F.when(band == "local", 1).when(band == "metro", 2).otherwise(4)
    return modelled if published is None else F.coalesce(published, modelled)


@dataclass
class Freight:
    """Columns of one delivery, per unit where not said otherwise."""

    km: Column
    band: Column
    chargeable_kg: Column
    vehicle: Column
    trips: Column
    trip_cost: Column  # of the whole delivery
    freight: Column
    handling: Column
    loading: Column
    basis: Column
    breakdown: Column


def delivery(km: Column, category: Column, unit_kg: Column, quantity: Column, unit_m3: Column | None = None, order_value: Column | None = None, free_from: Column | None = None, published: Column | None = None, geocoded: Column | None = None) -> Freight:
    """Delivery of ``quantity`` units over ``km``.

    ``published``: the seller's own charge a unit, which replaces the model;
    ``free_from``: order value from which delivery is free.
    """
    none = F.lit(None).cast("bigint")
    published, free_from = none if published is None else published, none if free_from is None else free_from
    order_value = none if order_value is None else order_value
    q = F.greatest(F.lit(1.0), quantity.cast("double"))
    volumetric = F.lit(0.0) if unit_m3 is None else F.coalesce(unit_m3, F.lit(0.0)) * q * VOLUMETRIC
    kg = F.greatest(unit_kg * q, volumetric)
    trips = F.greatest(F.lit(1), F.ceil(kg / _vehicle(kg, 1))).cast("bigint")
    by_road = F.greatest(half_up(km * _vehicle(kg, 2)), _vehicle(kg, 3).cast("bigint")) * trips
    modelled = F.when(vehicle_class(kg) == "parcel", F.lit(PARCEL_BASE) + half_up(kg * PARCEL_PER_KG)).otherwise(by_road)
    cost = F.coalesce(half_up(published * q), modelled)
    free = F.coalesce(order_value >= free_from, F.lit(False))
    freight = F.when(free, F.lit(0).cast("bigint")).otherwise(half_up(cost / q))
    handling = half_up(F.greatest(logistics(category, 2).cast("bigint"), half_up(kg * logistics(category, 1))) / q)
    loading = logistics(category, 0).cast("bigint")
    located = F.lit(True) if geocoded is None else geocoded
    basis = F.when(free, "free_delivery").when(published.isNotNull(), "vendor_published").when(located, "computed").otherwise("seeded_fallback")
    step = lambda name, value: F.struct(F.lit(name).alias("step"), value.cast("string").alias("value"))
    breakdown = F.array(step("distance", km), step("band", distance_band(km)), step("chargeable_kg", half_up(kg)), step("vehicle", vehicle_class(kg)), step("trips", trips), step("trip_cost", cost), step("freight", freight), step("handling", handling), step("loading", loading))
    return Freight(km, distance_band(km), kg, vehicle_class(kg), trips, cost, freight, handling, loading, basis, breakdown)
