"""Queries of whole rankings, guides and blocked lines, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bundles, pricing, quality, ranking, reports
from .catalogue import _FRESH, _SCORE, _scored, _surface, _with, query
from .offers import candidates, landed, table

_QUOTES = "select *, case when not quotable then 'PRICE_EXPIRED' when stock_state = 'out_of_stock' then 'OUT_OF_STOCK' end as blocked from g"


@query("bulk_blocked_lines", _with(f"""select l_orderkey as order_id, l_linenumber as line, reason, case reason when 'NOT_FOUND' then 404 when 'PRICE_EXPIRED' then 425 else 409 end as status from (
  select l_orderkey, l_linenumber, case when n is null then 'NOT_FOUND' else first_reason end as reason, coalesce(can, false) as can from (select *, case when l_orderkey % 10 = 0 then -l_partkey else l_partkey end as product_id from lineitem) x
  left join (select product_id, count(*) as n, bool_or(blocked is null) as can, arg_min(coalesce(blocked, 'none'), (stock_state = 'out_of_stock', landed_minor, offer_key)) as first_reason from ({_QUOTES}) group by product_id) q using (product_id)) where not can""", _FRESH))
def bulk_blocked_lines(spark, sf_dir):
    """Order lines that can't be quoted, each with its reason; one order in ten asks for products that are not there."""
    quotes = _surface(spark, sf_dir).withColumn("blocked", F.when(~F.col("quotable"), "PRICE_EXPIRED").when(F.col("stock_state") == "out_of_stock", "OUT_OF_STOCK")).withColumnRenamed("landed_minor", "unit_minor")
    product = F.when(F.col("l_orderkey") % 10 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), product.alias("product_id"))
    return pricing.blocked_lines(lines, quotes, "order_id").select("order_id", "line", "reason", "status")


@query("published_order", _with("""select category, region, rank_pos, offer_key from (select *, row_number() over (partition by category, region order by round(score_e6 / 1000.0)::bigint desc, landed_minor, fetched_at desc,
  case line_status when 'F' then 4 else 1 end desc, case when size % 4 > 0 then size % 5 + 1 else 0 end desc, offer_key) as rank_pos from r) where rank_pos <= 24""", _FRESH + _SCORE))
def published_order(spark, sf_dir):
    """The first offers of each category and region by all six keys; statuses and sizes stand in for certificates and ratings."""
    rows = _scored(spark, sf_dir, "offer_key", "fetched_at", "line_status", "size").withColumns({"score_e9": F.col("score_e3"), "cert_tier": F.when(F.col("line_status") == "F", 4).otherwise(1), "rating_e9": F.when(F.col("size") % 4 > 0, F.col("size") % 5 + 1).otherwise(0)})
    place = F.row_number().over(Window.partitionBy("category", "region").orderBy(*ranking.published_order()))  # a top-k: cut before the shuffle
    return rows.withColumn("rank_pos", place).where("rank_pos <= 24").select("category", "region", "rank_pos", "offer_key")


@query("type_guide_standards", _with("""select a.category, low_minor, high_minor, n_offers, n_vendors, element_median, standard from (
  select category, min(landed_minor)::bigint as low_minor, max(landed_minor)::bigint as high_minor, count(*)::bigint as n_offers, count(distinct vendor_id)::bigint as n_vendors, list_sort(list(landed_minor))[1 + len(list(landed_minor)) // 2] as element_median from l group by category) a
  join (select category, standard from (select category, standard, row_number() over (partition by category order by count(*) desc, standard) as n from (
    select category, unnest(case when size % 2 = 0 then ['IS ' || size % 7, 'IS ' || size % 3] else ['IS ' || size % 5] end) as standard from l) group by category, standard) where n = 1) b on a.category = b.category"""))
def type_guide_standards(spark, sf_dir):
    """The guide to each type with the standard that most offers state; sizes stand in for standards."""
    named = lambda n: F.concat(F.lit("IS "), (F.col("size") % n).cast("string"))
    rows = landed(candidates(spark, sf_dir)).withColumn("standards", F.when(F.col("size") % 2 == 0, F.array(named(7), named(3))).otherwise(F.array(named(5))))
    return quality.type_guide(rows, "category", "landed_minor", "standards").select("category", "low_minor", "high_minor", "n_offers", "n_vendors", "element_median", "standard")


@query("quality_winners", _with("""select category, size % 5 as application, arg_min(product_id, (-quality_bp, product_id)) as product_id, arg_min(quality_bp, (-quality_bp, product_id)) as quality_bp, count(*)::bigint as n_products from (
  select product_id, category, size, c, floor((size / 50.0::double * 0.40::double + case when c > 0 then 1.0::double else 0.3::double end * 0.25::double + (brand <> 'Brand#1')::int * 0.15::double
    + n::double / max(n) over (partition by category) * 0.20::double) * 10000 + 0.5)::bigint as quality_bp, max(case when c > 0 then 4 else 1 end) over (partition by category) as most_tier, min(case when c > 0 then 4 else 1 end) over (partition by category) as least_tier from (
  select product_id, category, size, brand, count(distinct vendor_id) as n, count(*) filter (line_status = 'F' and category <> 'cement') as c from o group by all))
  where most_tier > least_tier and most_tier >= 2 group by category, application"""))
def quality_winners(spark, sf_dir):
    """The best product for each of five applications, in categories where certificates tell products apart; cement has none."""
    certified = (F.col("line_status") == "F") & (F.col("category") != "cement")
    own = candidates(spark, sf_dir).groupBy("product_id", "category", "size", "brand").agg(F.countDistinct("vendor_id").alias("n"), F.count_if(certified).alias("c"))
    most = own.groupBy("category").agg(F.max("n").alias("most"))
    score = quality.quality(F.col("size") / 50, F.when(F.col("c") > 0, 1.0).otherwise(0.3), F.col("brand") != "Brand#1", F.col("n") / F.col("most"))
    rows = own.join(most, "category").withColumns({"quality_bp": score, "tier": F.when(F.col("c") > 0, 4).otherwise(1), "application": F.col("size") % 5})
    return quality.winners(rows, "quality_bp", "product_id", "tier", ["category"], "application")


@query("vendor_listings", _with("""select region, vendor_id, max(n)::bigint - 1 as n_others, arg_min(offer_key, place) as offer_key, min(landed_minor) filter (place = 1)::bigint as landed_minor,
  coalesce(string_agg(offer_key || '=' || landed_minor, ' ' order by place) filter (place between 2 and 6), '') as also_listed from (
  select *, count(*) over (partition by region, vendor_id) as n, row_number() over (partition by region, vendor_id order by stock_state = 'out_of_stock', landed_minor, offer_key) as place from l) where place <= 6 group by region, vendor_id"""))
def vendor_listings(spark, sf_dir):
    """Each vendor's best offer with its next five nested."""
    out = ranking.vendor_listings(landed(candidates(spark, sf_dir)), 5, "region")
    listed = F.array_join(F.transform("also_listed", lambda x: F.concat(x.offer_key, F.lit("="), x.landed_minor.cast("string"))), " ")
    return out.select("region", "vendor_id", "n_others", "offer_key", "landed_minor", listed.alias("also_listed"))


@query("product_page", _with("""select a.*, 'brand=' || brand || case when size % 3 > 0 then ' size=' || size else '' end as specs, subs as substitutes, case when a.category = 'cement' then case when a.region = 'ASIA' then 40000 else 35000 end when a.category = 'tmt_steel' then 6000 end::bigint as anchor_minor from (
  select product_id, region, category, count(*)::bigint as n_offers, count(distinct vendor_id)::bigint as n_sellers, min(landed_minor)::bigint as floor_minor from l group by all) a join (select p_partkey as product_id, p_brand as brand, p_size as size from part) p using (product_id)
  left join (select product_id, region, string_agg(other || '+' || gap, ' ' order by place) as subs from (
    select x.category, x.region, x.product_id, y.product_id as other, abs(x.m - y.m)::bigint as gap, row_number() over (partition by x.category, x.region, x.product_id order by abs(x.m - y.m), y.product_id) as place
    from s x join s y on x.category = y.category and x.region = y.region and x.product_id <> y.product_id) where place <= 6 group by product_id, region) t using (product_id, region)""", """,
s as (select category, region, product_id, min(landed_minor)::bigint as m from l group by all)"""))
def product_page(spark, sf_dir):
    """Every product's page in every region: offers, specs, the nearest-priced others, and the public rate."""
    rows = landed(candidates(spark, sf_dir))
    detail = rows.groupBy("product_id", "region", "category").agg(F.count("*").alias("n_offers"), F.countDistinct("vendor_id").alias("n_sellers"), F.min("landed_minor").alias("floor_minor"))
    fields = F.explode(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("field"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).alias("value"))))
    specs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), fields.alias("f")).select("product_id", "f.*")
    anchors = spark.sql("select * from values ('cement', 'ASIA', 40000L), ('cement', null, 35000L), ('tmt_steel', null, 6000L) as t(category, region, rate_minor)")
    page = bundles.product_page(detail, specs, reports.substitutes(detail.select("category", "region", "product_id", "floor_minor")), anchors)
    specs_text = F.array_join(F.transform("specs", lambda x: F.concat(x.field, F.lit("="), x.value)), " ")
    others = F.array_join(F.transform("substitutes", lambda x: F.concat(x.other.cast("string"), F.lit("+"), x.gap.cast("string"))), " ")
    return page.withColumns({"specs": specs_text, "substitutes": others}).select("product_id", "region", "category", "n_offers", "n_sellers", "floor_minor", "specs", "substitutes", "anchor_minor")
