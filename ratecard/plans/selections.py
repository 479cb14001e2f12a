"""Queries of exact order statistics without a group in one task, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from .catalogue import _FRESH, _surface, _with, query
from .offers import candidates, landed


@query("category_medians", _with("select category, region, floor(median(landed_minor) + 0.5)::bigint as median_minor from g where quotable group by category, region", _FRESH))
def category_medians(spark, sf_dir):
    """The median of the quotable offers of each category and region, as ``category_stats`` has it."""
    return selection.selected_median(_surface(spark, sf_dir).where("quotable"), ["category", "region"], "landed_minor")


@query("product_medians", _with("select product_id, region_id, floor(median(landed_minor) + 0.5)::bigint as median_minor from l group by product_id, region_id"))
def product_medians(spark, sf_dir):
    """The median of the offers of each product and region, as ``price_summary`` has it."""
    return selection.selected_median(landed(candidates(spark, sf_dir)), ["product_id", "region_id"], "landed_minor")


@query("price_percentiles", _with("""select region, p, v[greatest(ceil(p * len(v) / 100.0)::bigint, 1)]::bigint as landed_minor from (select region, list_sort(list(landed_minor)) as v from l group by region), (values (5), (50), (95), (100)) as x(p)"""))
def price_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of all offers of a region."""
    out = selection.nearest_ranks(landed(candidates(spark, sf_dir)), ["region"], "landed_minor", (5, 50, 95, 100))
    return out.withColumnRenamed("value", "landed_minor")


@query("region_median_parity", _with("""select category, region, floor(median(landed_minor) * 10000 / max(all_median) + 0.5)::bigint as ratio_bp from (select *, median(landed_minor) over (partition by category) as all_median from l) group by category, region""").replace("median(landed_minor) * 10000 / max(all_median)", "floor(median(landed_minor) + 0.5) * 10000 / max(floor(all_median + 0.5))"))
def region_median_parity(spark, sf_dir):
    """Each region's median against that of its category everywhere, in basis points."""
    rows = landed(candidates(spark, sf_dir)).select("category", "region", "landed_minor")
    each = selection.selected_median(rows, ["category", "region"], "landed_minor")
    everywhere = selection.selected_median(rows, ["category"], "landed_minor", "all_median")
    return each.join(everywhere, "category").select("category", "region", F.floor(F.col("median_minor") * 10000 / F.col("all_median") + 0.5).cast("bigint").alias("ratio_bp"))
