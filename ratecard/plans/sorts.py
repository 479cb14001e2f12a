"""The query of all column sorts, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import column_sorts
from ..sources.scratch import stored
from .catalogue import _with, query
from .offers import candidates, landed

#: What stands in for each column, as SQL over one row for each product and region.
_FROM = {
    "landed_minor": "lo", "trade_minor": "lo * 2", "floor_minor": "lo", "median_minor": "(lo + hi) / 2", "rating": "case when size % 4 > 0 then size % 5 + 1 end", "reviews": "case when size % 3 > 0 then size end",
    "moq": "moq", "n_offers": "n", "n_sellers": "sellers", "lead_days": "lead", "fetched_at": "latest", "cert_tier": "size % 5", "rate_bp": "rate", "mrp_minor": "case when size % 2 = 0 then hi end", "score_e9": "hi - lo",
    "title": "title", "brand": "case when size % 7 > 0 then brand end", "vendor_name": "seller", "locality": "case when size % 6 > 0 then region end", "platform": "category", "hsn": "case when size % 5 > 0 then '25' || size end", "origin": "case when size % 9 > 2 then brand end",
    "pack_size_kg": "case when category = 'cement' then size end", "diameter_mm": "case when category = 'tmt_steel' then size end", "nominal_bore_mm": "case when category = 'water_pipes' then size end", "length_m": "case when size % 3 = 0 then size * 2 end", "density_kg_m3": "case when category = 'bricks_blocks' then size * 10 end",
    "cement_type": "case when category = 'cement' then title end", "opc_grade": "case when category = 'cement' then '' || size end", "pipe_system": "case when category = 'water_pipes' then brand end", "block_type": "case when category = 'bricks_blocks' then title end", "size_mm": "size || '×' || size",
    "material": "case when size % 2 = 0 then title else '' end", "color": "case when size % 3 = 0 then title end", "supply_type": "case when size % 4 = 0 then 'Manufacturer' when size % 4 = 1 then 'reseller' end", "trade_type": "case when size % 5 = 0 then 'Trade' when size % 5 = 1 then 'non-trade' end",
}
_CARDS = """select product_id, region, min(landed_minor) as lo, max(landed_minor) as hi, count(*) as n, count(distinct vendor_id) as sellers, max(fetched_at) as latest, min(lead_days) as lead, min(moq) as moq, max(rate_bp) as rate,
  min(vendor_name) as seller, min(title) as title, min(brand) as brand, min(category) as category, min(size) as size from {} group by product_id, region"""
_FIRST = 12


def _top(name: str, descending: bool) -> str:
    own = column_sorts.column_of(name)
    value = f"nullif(lower({own}::varchar), '') collate en" if column_sorts.REGISTRY[name] == "text" else f"{own}"
    return f"(select '{name}' as sort, {str(descending).lower()} as descending, product_id, region from s order by {value} {'desc' if descending else 'asc'} nulls last, product_id, region limit {_FIRST})"


@query("column_sorts_all", _with(" union all ".join(_top(n, d) for n in column_sorts.REGISTRY for d in (False, True)), f""",
c as ({_CARDS.format("l")}), s as (select product_id, region, {", ".join(f"{v} as {k}" for k, v in _FROM.items())} from c)"""))
def column_sorts_all(spark, sf_dir):
    """The first products by each of 36 columns, upwards and downwards; unknown values last both ways."""
    rows = landed(candidates(spark, sf_dir))
    cards = spark.sql(_CARDS.format("{rows}"), rows=rows)
    made = cards.select("product_id", "region", *(F.expr(v).alias(k) for k, v in _FROM.items()))
    return column_sorts.first_by_columns(stored(made, "cards"), _FIRST, "product_id", "region")
