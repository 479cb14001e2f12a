"""Exact order statistics of groups of any size, by distributed selection.

Rows become counts of distinct values first (a partial aggregate), counts are summed
by bands of values, a running sum over the few bands of a group tells which band a
rank falls into, and only inside that band values are run through. So no task holds
or sorts a group: the most that meets is one band's distinct values, and the bands
of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import amount_band

_NONE = -(1 << 62)


def ranked_counts(rows: DataFrame, group: list[str], value: str, band: Column | None = None) -> DataFrame:
    """(group, value, n, before, total): how often each value is in its group, and how many smaller ones.

    ``band``: an integer that never falls along the values; by default one for amounts.
    Null values are left out. Groups may be null and stay apart.
    """
    held = rows.where(F.col(value).isNotNull()).select(*(F.struct(F.col(g).alias("v")).alias(g) for g in group), F.col(value).alias("value"))
    counts = held.groupBy(*group, "value").agg(F.count("*").alias("n"))
    own = (amount_band(F.col("value")) if band is None else band).cast("bigint")
    counts = counts.withColumn("_band", F.coalesce(own, F.lit(_NONE))).repartition(*group, "_band")
    # read from the same exchange as the counts: sums of them, and a use of the values so that these stay in it
    sums = counts.groupBy(*group, "_band").agg(F.sum("n").alias("_n"), F.max("value").alias("_most")).where("_most is not null").drop("_most")
    w = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum("_n").over(w.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, "_band", earlier.alias("_before"), F.sum("_n").over(w).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy(*group, "_band").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_within", within).join(sums, [*group, "_band"])
    return placed.select(*(F.col(g)["v"].alias(g) for g in group), "value", "n", (F.col("_before") + F.col("_within")).alias("before"), "total")


def selected_median(rows: DataFrame, group: list[str], value: str, name: str = "median_minor") -> DataFrame:
    """(group, ``name``): the middle value, or the half-up mean of both middle ones; groups without a value have no row."""
    counts = ranked_counts(rows, group, value)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    middle = counts.where(holds(low) | holds(high))
    ends = middle.groupBy(*group).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    return ends.select(*group, F.expr("cast(floor((_a + _b + 1) / 2) as bigint)").alias(name))


def nearest_ranks(rows: DataFrame, group: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """(group, p, value): the least value that at least p percent of the group do not exceed."""
    counts = ranked_counts(rows, group, value)
    asked = counts.withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    rank = F.greatest(F.expr("(p * total + 99) div 100") - 1, F.lit(0))
    return asked.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).select(*group, "p", "value")
