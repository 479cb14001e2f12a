"""The pricing contract: offers of a product, as of a time, for a quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import freight, money
from ..functions.freshness import age_hours, freshness_state


def resolve(rows: DataFrame, quantity: Column, as_of: Column, sla: Column) -> DataFrame:
    """Every offer priced anew for ``quantity``: parts, total, and why it cannot be quoted.

    ``rows``: those of ``candidates`` with ``km`` (the road to the buyer).
    """
    d = freight.delivery(F.col("km"), F.col("category"), F.col("size").cast("double"), quantity)
    rows = rows.withColumns({"quantity": quantity.cast("bigint"), "gst_minor": money.tax_on(F.col("base_minor"), F.col("rate_bp")), "freight_minor": d.freight, "handling_minor": d.handling, "loading_minor": d.loading})
    rows = rows.withColumn("unit_minor", F.expr("base_minor + gst_minor + freight_minor + handling_minor + loading_minor"))
    rows = rows.withColumn("freshness", freshness_state(age_hours(F.col("fetched_at"), as_of), sla))
    blocked = F.when(F.col("freshness") == "EXPIRED", "PRICE_EXPIRED").when(F.col("stock_state") == "out_of_stock", "OUT_OF_STOCK").when(F.col("moq") > F.col("quantity"), "BELOW_MINIMUM")
    return rows.withColumn("blocked", blocked).withColumn("total_minor", F.col("unit_minor") * F.col("quantity"))


#: What a line is blocked by if no offer of its product is there at all.
NOT_FOUND = "NOT_FOUND"


def status(blocked: Column) -> Column:
    """The response status of a quote: not found, too early to quote, in conflict, or fine."""
    return F.when(blocked == NOT_FOUND, 404).when(blocked == "PRICE_EXPIRED", 425).when(blocked.isNotNull(), 409).otherwise(200)


def pricing_order() -> list[Column]:
    return [F.expr("stock_state = 'out_of_stock'").asc(), F.asc("unit_minor"), F.asc("offer_key")]


def bulk_quote(lines: DataFrame, quotes: DataFrame, order: str, product: str = "product_id") -> DataFrame:
    """For each order: priced and blocked lines and the sum of the priced ones, at each product's cheapest quote."""
    best = quotes.where("blocked is null").groupBy(product).agg(F.min("unit_minor").alias("unit_minor"))
    priced = lines.join(best, product, "left")
    return priced.groupBy(order).agg(F.count("*").alias("n_lines"), F.count_if(F.col("unit_minor").isNull()).alias("n_blocked"), F.coalesce(F.sum(F.col("unit_minor") * F.col("quantity")), F.lit(0)).cast("bigint").alias("total_minor"))


def blocked_lines(lines: DataFrame, quotes: DataFrame, order: str, product: str = "product_id") -> DataFrame:
    """``lines`` that no offer can be quoted for, with the reason and the status: that of the offer
    which comes first in pricing order, or that there is none. Aggregates by product, no order of offers."""
    first = F.struct((F.col("stock_state") == "out_of_stock").alias("o"), "unit_minor", "offer_key")
    known = quotes.groupBy(product).agg(F.bool_or(F.col("blocked").isNull()).alias("_quotable"), F.min_by("blocked", first).alias("reason"))
    held = lines.join(known, product, "left").where(~F.coalesce("_quotable", F.lit(False))).withColumn("reason", F.coalesce("reason", F.lit(NOT_FOUND)))
    return held.withColumn("status", status(F.col("reason"))).drop("_quotable")


def cart_totals(lines: DataFrame, cart: str) -> DataFrame:
    """Sum, the tax inside it, net, units and lines of each cart; invalid lines are left out."""
    good = lines.where("quantity > 0 and unit_minor > 0")
    sub = F.col("quantity") * F.col("unit_minor")
    return good.groupBy(cart).agg(F.sum(sub).cast("bigint").alias("gross_minor"), F.sum(money.tax_inside(sub, F.col("rate_bp"))).cast("bigint").alias("tax_minor"), F.sum("quantity").cast("bigint").alias("units"), F.count("*").alias("n_lines")).withColumn("net_minor", F.col("gross_minor") - F.col("tax_minor"))


def compare_set(rows: DataFrame, *group: str) -> DataFrame:
    """Least, most, spread and its share of a set of products, if they share a unit."""
    return rows.groupBy(*group).agg((F.countDistinct("unit") == 1).alias("comparable"), F.min("landed_minor").alias("low_minor"), F.max("landed_minor").alias("high_minor")).withColumn("spread_minor", F.col("high_minor") - F.col("low_minor")).withColumn("spread_bp", F.floor((F.col("high_minor") - F.col("low_minor")) * 10_000 / F.col("low_minor") + 0.5).cast("bigint"))
