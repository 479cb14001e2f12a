"""Sorting results by a column's header: a registry of columns, each in both directions.

Values that are unknown come last in both; texts are collated without case, as a
reader's language orders them; equal values keep the order they had.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that a sort can be asked for by.
#: Of every result.
NUMBERS = "unit_price, landed, floor, median, rating, reviews, moq, offers, sellers, eta, verified, cert, gst, mrp, score".split(", ")
TEXTS = "product, brand, seller, locality, platform, hsn, origin".split(", ")
#: Attributes, which are sensible within a category.
ATTRIBUTE_NUMBERS = "pack_size_kg, diameter_mm, nominal_bore_mm, length_m, density_kg_m3".split(", ")
ATTRIBUTE_TEXTS = "cement_type, opc_grade, pipe_system, block_type, size_mm, material, color, supply_type, trade_type".split(", ")
#: Where this engine's rows have the value under another name than the sort's.
COLUMNS = {"unit_price": "landed_minor", "landed": "trade_minor", "floor": "floor_minor", "median": "median_minor", "reviews": "reviews", "offers": "n_offers", "sellers": "n_sellers", "eta": "lead_days", "verified": "fetched_at", "cert": "cert_tier", "gst": "rate_bp", "mrp": "mrp_minor", "score": "score_e9", "product": "title", "seller": "vendor_name"}
COLLATION = "UNICODE"

REGISTRY: dict[str, str] = {**dict.fromkeys(NUMBERS + ATTRIBUTE_NUMBERS, "number"), **dict.fromkeys(TEXTS + ATTRIBUTE_TEXTS, "text")}


def column_of(name: str) -> str:
    return COLUMNS.get(name, name)


def sort_value(name: str, columns: list[str]) -> Column:
    """The value that a row is sorted by: a number, or a collated text; null where it is unknown or blank."""
    if name not in REGISTRY:
        raise ValueError(f"unknown column {name!r}; known: {', '.join(REGISTRY)}")
    own = column_of(name)
    if own not in columns:
        return F.lit(None).cast("double")
    if REGISTRY[name] == "number":
        return F.unix_micros(F.col(own).cast("timestamp")).cast("double") if name == "verified" else F.col(own).cast("double")
    text = F.lower(F.col(own).cast("string"))
    return F.collate(F.when(text != "", text), COLLATION)


def column_sort(name: str, descending: bool, columns: list[str], *ties: Column) -> list[Column]:
    """The order of a column's header, unknown values last; ``ties`` is the order that equal rows had."""
    value = sort_value(name, columns)
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), *ties]


def direction(name: str, descending: bool) -> str:
    """What a direction is called."""
    if REGISTRY.get(name) == "text":
        return "Z–A" if descending else "A–Z"
    if name == "verified":
        return "most recent first" if descending else "oldest first"
    return "highest first" if descending else "lowest first"


def first_by_columns(rows: DataFrame, n: int, *ties: str) -> DataFrame:
    """(sort, descending, and ``ties``) of the first ``n`` rows by each column in both directions.

    Each is a top n of its own, cut where rows are read: nothing is sorted whole.
    """
    parts = []
    for name in REGISTRY:
        for descending in (False, True):
            top = rows.orderBy(*column_sort(name, descending, rows.columns, *(F.asc(t) for t in ties))).limit(n)
            parts.append(top.select(F.lit(name).alias("sort"), F.lit(descending).alias("descending"), *ties))
    return reduce(DataFrame.unionAll, parts)
