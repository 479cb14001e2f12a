"""Guides to a category's products: typical prices, and a quality rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The shares of the rubric, and grades from 0 to 1.
RUBRIC = {"grade": 0.40, "certification": 0.25, "branded": 0.15, "breadth": 0.20}
GRADES = {"53 grade": 1.0, "43 grade": 0.75, "33 grade": 0.5, "Fe 550D": 1.0, "Fe 550": 0.9, "Fe 500D": 0.8, "Fe 500": 0.7, "Fe 415": 0.5}


def element_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, element_median): the value at place floor(n / 2) in order, from 0; never an average.

    From counts of distinct values, so no group is gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(*group))
    place = F.floor(F.col("total") / 2)
    placed = counts.withColumns({"upto": upto, "total": total}).where((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place))
    return placed.select(*group, F.col(value).alias("element_median"))


def type_guide(rows: DataFrame, kind: str, amount: str, standards: str | None = None) -> DataFrame:
    """Median element, range, offers and vendors of each type; the most common standard, ties by name."""
    base = rows.groupBy(kind).agg(F.min(amount).alias("low_minor"), F.max(amount).alias("high_minor"), F.count("*").alias("n_offers"), F.countDistinct("vendor_id").alias("n_vendors"))
    out = base.join(element_median(rows, [kind], amount), kind)
    if standards is None:
        return out
    counts = rows.select(kind, F.explode(standards).alias("standard")).groupBy(kind, "standard").agg(F.count("*").alias("n"))
    common = counts.groupBy(kind).agg(F.min_by("standard", F.struct(-F.col("n"), "standard")).alias("standard"))
    return out.join(common, kind, "left")


def quality(grade: Column, certification: Column, branded: Column, breadth: Column) -> Column:
    """The rubric's score in ten-thousandths; each part from 0 to 1."""
    parts = {"grade": grade, "certification": certification, "branded": branded.cast("double"), "breadth": breadth}
    return F.floor(sum((F.coalesce(parts[k], F.lit(0.0)) * w for k, w in RUBRIC.items()), F.lit(0.0)) * 10_000 + 0.5).cast("bigint")


def grade_value(grade: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in GRADES.items():
        out = F.when(grade == name, F.lit(value)).otherwise(out)
    return out


def rankable(rows: DataFrame, tier: str, *group: str) -> DataFrame:
    """Whether certification can tell products (of each group) apart at all: several tiers, one of them a declared one."""
    return rows.groupBy(*group).agg(((F.countDistinct(tier) > 1) & (F.max(tier) >= 2)).alias("rankable"))


def winners(rows: DataFrame, score: str, key: str, tier: str, group: list[str], application: str) -> DataFrame:
    """The best product for each application of a group, where the group is rankable: score, ties by key. A maximum, not an order."""
    best = rows.groupBy(*group, application).agg(F.min_by(F.struct(key, score), F.struct((-F.col(score)).alias("s"), key)).alias("_w"), F.count("*").alias("n_products"))
    return best.join(rankable(rows, tier, *group).where("rankable"), group).select(*group, application, f"_w.{key}", f"_w.{score}", "n_products")
