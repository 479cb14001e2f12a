"""Age of a price against its service level. ``as_of`` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours that a price of a volatility class stays good, and the class of each category.
SLA_HOURS = {"V0": 24, "V1": 168, "V2": 720, "V3": 2160}
VOLATILITY = {"cement": "V0", "tmt_steel": "V0", "bricks_blocks": "V0", "water_pipes": "V1"}
STALE_PENALTY = 0.25


def sla_hours(category: Column, default: int = 24) -> Column:
    out = F.lit(default)
    for name, kind in VOLATILITY.items():
        out = F.when(category == name, F.lit(SLA_HOURS[kind])).otherwise(out)
    return out


def age_hours(priced: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(priced.cast("timestamp"))) / F.lit(3_600_000_000.0))


def freshness_state(age: Column, sla: Column) -> Column:
    """FRESH under half of the service level, AGEING under it, STALE under three times it, else EXPIRED."""
    ratio = age / sla
    return F.when(ratio < 0.5, "FRESH").when(ratio < 1, "AGEING").when(ratio < 3, "STALE").otherwise("EXPIRED")


def quotable(state: Column) -> Column:
    return state != "EXPIRED"


def stale_penalty(state: Column) -> Column:
    return F.when(state.isin("STALE", "EXPIRED"), F.lit(STALE_PENALTY)).otherwise(F.lit(0.0))


def dot(age: Column) -> Column:
    return F.when(age < 24, "green").when(age < 72, "amber").otherwise("red")


def humanise(age: Column) -> Column:
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(f" {unit} ago"))
    return F.when(age < 1, "just now").when(age < 24, n(age, "h")).when(age < 24 * 30, n(age / 24, "d")).otherwise(n(age / (24 * 30), "mo"))


def format_ist(ts: Column) -> Column:
    """A UTC time in India, which has one fixed offset: 17 Aug 2026, 7:39 am."""
    return F.concat(F.date_format(ts + F.expr("interval 330 minutes"), "d MMM yyyy, h:mm "), F.lower(F.date_format(ts + F.expr("interval 330 minutes"), "a")))
