"""Money in integer minor units, rates in basis points: Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 1/2) as BIGINT; unlike round(), -2.5 becomes -2."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def ratio_half_up(a: Column, b: Column) -> Column:
    """Half-up a / b of integers, without leaving integers; b > 0."""
    return F.floor((a * 2 + b) / (b * 2)).cast("bigint")


def tax_on(base: Column, rate_bp: Column) -> Column:
    """Tax on an amount that excludes it."""
    return half_up(base * rate_bp / F.lit(10_000))


def base_of_inclusive(amount: Column, rate_bp: Column) -> Column:
    """The amount before tax of one that includes it."""
    return half_up(amount * F.lit(10_000) / (rate_bp + F.lit(10_000)))


def tax_inside(amount: Column, rate_bp: Column) -> Column:
    return half_up(amount * rate_bp / (rate_bp + F.lit(10_000)))


def minor_from_rupee_text(text: Column) -> Column:
    """'₹ 1,250' or 'Rs. 8.05' in paise; null unless it is one amount of at most two decimals."""
    bare = F.regexp_replace(F.trim(text), "[₹,\\s]", "")
    bare = F.regexp_replace(bare, "(?i)^rs\\.?", "")
    whole, part = F.regexp_extract(bare, "^(\\d+)(?:\\.(\\d{1,2}))?$", 1), F.regexp_extract(bare, "^(\\d+)(?:\\.(\\d{1,2}))?$", 2)
    return F.when(whole != "", whole.try_cast("bigint") * 100 + F.rpad(part, 2, "0").try_cast("bigint"))


def format_minor(amount: Column) -> Column:
    """Rupees with two decimals and Indian digit groups: 12,34,567.00."""
    whole = F.floor(F.abs(amount) / 100).cast("bigint").cast("string")
    head = F.regexp_replace(F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0))), "(\\d)(?=(\\d\\d)+$)", "$1,")
    tail = F.substring(whole, F.greatest(F.length(whole) - 2, F.lit(1)), F.lit(3))
    text = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), tail)).otherwise(whole)
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), text, F.lit("."), F.lpad((F.abs(amount) % 100).cast("string"), 2, "0"))


def compact_minor(amount: Column) -> Column:
    """₹1.25Cr, ₹3.40L, ₹5.6k or whole rupees."""
    r = amount / 100
    scaled = lambda by, unit, form: F.concat(F.lit("₹"), F.format_string(form, r / by), F.lit(unit))
    whole = F.regexp_replace(format_minor(amount), r"\.\d\d$", "")
    return F.when(F.abs(r) >= 1e7, scaled(1e7, "Cr", "%.2f")).when(F.abs(r) >= 1e5, scaled(1e5, "L", "%.2f")).when(F.abs(r) >= 1e3, scaled(1e3, "k", "%.1f")).otherwise(whole)


def relative_percent(now: Column, before: Column) -> Column:
    """Change against ``before`` in percent; 0 if that is 0."""
    return F.when(before == 0, F.lit(0.0)).otherwise((now - before) * 100.0 / before)


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent; 0 if there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def median_minor(amount: Column) -> Column:
    """The median of a group; an even group's two middle amounts are averaged half-up; 0 if empty."""
    return F.coalesce(F.floor(F.percentile(amount, 0.5) + 0.5).cast("bigint"), F.lit(0).cast("bigint"))


def clamp_quantity(quantity: Column, least: Column) -> Column:
    """A whole quantity between the minimum order and 9999."""
    return F.least(F.lit(9999), F.greatest(F.ceil(F.coalesce(least, F.lit(1))), half_up(quantity))).cast("bigint")
