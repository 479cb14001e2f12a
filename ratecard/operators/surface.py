"""The price surface: summaries, statistics and coverage of landed offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.freshness import age_hours, freshness_state, quotable
from ..functions.money import median_minor


def price_summary(rows: DataFrame) -> DataFrame:
    """For each product and region: the best offer (in stock, then cheapest), floor, ceiling, median and counts."""
    order = F.struct((F.col("stock_state") == "out_of_stock").alias("o"), "landed_minor", "offer_key")
    return rows.groupBy("product_id", "region_id").agg(
        F.min_by("offer_key", order).alias("best_offer"),
        F.min("landed_minor").alias("floor_minor"),
        F.max("landed_minor").alias("ceiling_minor"),
        median_minor(F.col("landed_minor")).alias("median_minor"),
        F.count("*").alias("n_offers"),
        F.countDistinct("vendor_id").alias("n_vendors"),
        F.max("fetched_at").alias("latest"),
    )


def with_freshness(rows: DataFrame, as_of: Column, sla: Column) -> DataFrame:
    rows = rows.withColumn("age_hours", age_hours(F.col("fetched_at"), as_of)).withColumn("sla_hours", sla)
    rows = rows.withColumn("freshness", freshness_state(F.col("age_hours"), F.col("sla_hours")))
    return rows.withColumn("quotable", quotable(F.col("freshness")))


def category_stats(rows: DataFrame) -> DataFrame:
    """For each category and region: products, offers, sellers; amounts over quotable offers only."""
    good = F.when(F.col("quotable"), F.col("landed_minor"))
    return rows.groupBy("category", "region").agg(
        F.countDistinct("product_id").alias("n_products"),
        F.count("*").alias("n_offers"),
        F.countDistinct("vendor_id").alias("n_sellers"),
        F.min(good).alias("low_minor"),
        F.max(good).alias("high_minor"),
        median_minor(good).alias("median_minor"),
        F.count_if("quotable").alias("n_quotable"),
        F.count_if(F.col("freshness") == "FRESH").alias("n_fresh"),
        F.max("fetched_at").alias("latest"),
    )


def brand_top(rows: DataFrame, n: int = 12) -> DataFrame:
    """The brands of most sellers in each region; ties by products, then name."""
    stats = rows.where("trim(brand) <> ''").groupBy("region", "brand").agg(F.countDistinct("vendor_id").alias("n_sellers"), F.countDistinct("product_id").alias("n_products"))
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("n_sellers"), F.desc("n_products"), "brand"))
    return stats.withColumn("place", place).where(F.col("place") <= n)


def coverage(rows: DataFrame, floors: tuple[int, int, int] = (25, 6, 4)) -> DataFrame:
    """Offers, vendors and brands of each category and region against floors."""
    found = rows.groupBy("category", "region").agg(F.countDistinct("offer_key").alias("offers"), F.countDistinct("vendor_id").alias("vendors"), F.countDistinct("brand").alias("brands"))
    met = (F.col("offers") >= floors[0]) & (F.col("vendors") >= floors[1]) & (F.col("brands") >= floors[2])
    return found.withColumn("meets_floor", met)


def coverage_pivot(rows: DataFrame, regions: list[str]) -> DataFrame:
    """One row for each category, a column of offers for each region."""
    return rows.groupBy("category").pivot("region", regions).agg(F.count(F.lit(1))).na.fill(0)


def price_bands(rows: DataFrame, group: str = "category", amount: str = "landed_minor") -> DataFrame:
    """Bands between nearest-rank quartiles, half-open, with their counts; under four values one band.

    One pass: rows are counted by distinct amount, and ranks, cuts and bands follow
    from the counts, of which there are no more than amounts in minor units.
    """
    counts = rows.select(group, F.col(amount).alias("v")).where("v is not null").groupBy(group, "v").agg(F.count("*").alias("n"))
    own = Window.partitionBy(group)
    placed = counts.withColumns({"upto": F.sum("n").over(own.orderBy("v")), "total": F.sum("n").over(own)})
    at = lambda p: F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
    cut = lambda p: F.max(F.when((F.col("upto") > at(p)) & (F.col("upto") - F.col("n") <= at(p)), F.col("v"))).over(own)
    placed = placed.withColumns({"q1": cut(0.25), "q2": cut(0.5), "q3": cut(0.75)})
    rounded = lambda c: (F.when(F.col(c) >= 100_000, F.floor(F.col(c) / 10_000 + 0.5) * 10_000).when(F.col(c) >= 10_000, F.floor(F.col(c) / 1_000 + 0.5) * 1_000).otherwise(F.floor(F.col(c) / 100 + 0.5) * 100)).cast("bigint")
    edges = F.when(F.col("total") < 4, F.array().cast("array<bigint>")).otherwise(F.filter(F.array_distinct(F.array(rounded("q1"), rounded("q2"), rounded("q3"))), lambda c: c > 0))
    banded = placed.withColumn("cuts", edges).withColumn("band", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    low, high = F.get("cuts", F.col("band") - 1), F.get("cuts", F.col("band"))
    return banded.withColumns({"low_minor": low, "high_minor": high}).groupBy(group, "band", "low_minor", "high_minor").agg(F.sum("n").cast("bigint").alias("n"))


def lead_time_join(rows: DataFrame, serviceability: DataFrame) -> DataFrame:
    """The offer's own lead time, else that of its region's service; offers without either stay."""
    return rows.join(serviceability.withColumnRenamed("lead_days", "service_lead"), "region_id", "left").withColumn("lead", F.coalesce("lead_days", "service_lead"))
