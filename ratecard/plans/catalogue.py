"""The engine's queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import freight, money
from ..operators import estimate, facets, grounding, plausibility, pricing, quality, ranking, reports, retrieval, surface
from ..sources import listings
from ..streaming import events as streams
from .offers import AS_OF, SQL, candidates, landed, offers, products, table, vendors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Service levels of the stand-in categories, in hours; line items are years old.
SLA = {"cement": 24 * 365, "tmt_steel": 24 * 400, "water_pipes": 24 * 730}
SLA_DEFAULT = 24 * 500


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _with(body: str, more: str = "") -> str:
    return f"with {SQL.strip()}{more} {body}"


def _sla():
    out = F.lit(SLA_DEFAULT)
    for k, v in SLA.items():
        out = F.when(F.col("category") == k, F.lit(v)).otherwise(out)
    return out


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.with_freshness(landed(candidates(spark, sf_dir)), _as_of(), _sla())


_FRESH = f""",
f as (select *, greatest(0, date_diff('hour', fetched_at, timestamp '{AS_OF}'))::double as age_hours,
  case category {" ".join(f"when '{k}' then {v}" for k, v in SLA.items())} else {SLA_DEFAULT} end as sla_hours from l),
g as (select *, case when age_hours / sla_hours < 0.5 then 'FRESH' when age_hours / sla_hours < 1 then 'AGEING' when age_hours / sla_hours < 3 then 'STALE' else 'EXPIRED' end as freshness,
  age_hours / sla_hours < 3 as quotable from f)"""
_SCORE = """,
r0 as (select *, 0.5 * 0.31::double as w1, 0.5 * 0.16::double as w2, (1 - percent_rank() over (partition by category, region order by landed_minor)) * 0.16::double as w3,
  (case when stock_state = 'out_of_stock' then 0.0 when coalesce(lead_days, 3) > 7 then 0.5 else 1.0 end)::double * 0.10::double as w4,
  (3.9::double * 0 + 3.9::double * 20) / 20 / 5 * 0.10::double as w5, 0.3::double * 0.07::double as w6, exp(-coalesce(lead_days, 3)::double / 7) * 0.06::double as w7,
  (1 - least(1.0::double, age_hours / sla_hours)) * 0.04::double as w9 from g),
r as (select *, floor((w1 + w2 + w3 + w4 + w5 + w6 + w7 + w9
  - (case when freshness in ('STALE', 'EXPIRED') then 0.25 else 0.0 end + case when stock_state = 'out_of_stock' then 0.60 else 0.0 end + case when moq > 25 then 0.35 else 0.0 end)::double) * 1e6 + 0.5)::bigint as score_e6 from r0)"""
_MEDIAN = lambda x, where="": f"coalesce(floor(median({x}){where} + 0.5), 0)::bigint"


@query("landed_price", _with("select offer_key, base_minor, gst_minor, freight_minor, handling_minor, loading_minor, landed_minor, vehicle from l"))
def landed_price(spark, sf_dir):
    """Every offer's landed price by its parts."""
    return landed(candidates(spark, sf_dir)).select("offer_key", "base_minor", "gst_minor", "freight_minor", "handling_minor", "loading_minor", "landed_minor", "vehicle")


@query("price_summary", _with(f"""select product_id, region_id, arg_min(offer_key, (case when stock_state = 'out_of_stock' then 1 else 0 end, landed_minor, offer_key)) as best_offer,
  min(landed_minor)::bigint as floor_minor, max(landed_minor)::bigint as ceiling_minor, {_MEDIAN("landed_minor")} as median_minor,
  count(*)::bigint as n_offers, count(distinct vendor_id)::bigint as n_vendors, max(fetched_at) as latest from l group by product_id, region_id"""))
def price_summary(spark, sf_dir):
    return surface.price_summary(landed(candidates(spark, sf_dir)))


@query("category_stats", _with(f"""select category, region, count(distinct product_id)::bigint as n_products, count(*)::bigint as n_offers, count(distinct vendor_id)::bigint as n_sellers,
  (min(landed_minor) filter (quotable))::bigint as low_minor, (max(landed_minor) filter (quotable))::bigint as high_minor, {_MEDIAN("landed_minor", " filter (quotable)")} as median_minor,
  count(*) filter (quotable)::bigint as n_quotable, count(*) filter (freshness = 'FRESH')::bigint as n_fresh, max(fetched_at) as latest from g group by category, region""", _FRESH))
def category_stats(spark, sf_dir):
    return surface.category_stats(_surface(spark, sf_dir))


@query("brand_top12", _with("""select region, brand, n_sellers, n_products, place from (
  select *, row_number() over (partition by region order by n_sellers desc, n_products desc, brand) as place from (
    select region, brand, count(distinct vendor_id)::bigint as n_sellers, count(distinct product_id)::bigint as n_products from o where trim(brand) <> '' group by region, brand)) where place <= 12"""))
def brand_top12(spark, sf_dir):
    return surface.brand_top(candidates(spark, sf_dir))


@query("coverage_floor", _with("""select *, offers >= 25 and vendors >= 6 and brands >= 4 as meets_floor from (
  select category, region, count(distinct offer_key)::bigint as offers, count(distinct vendor_id)::bigint as vendors, count(distinct brand)::bigint as brands from o group by category, region)"""))
def coverage_floor(spark, sf_dir):
    return surface.coverage(candidates(spark, sf_dir))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("coverage_pivot", _with("select category, " + ", ".join(f"count(*) filter (region = '{r}')::bigint as \"{r}\"" for r in _REGIONS) + " from o group by category"))
def coverage_pivot(spark, sf_dir):
    return surface.coverage_pivot(candidates(spark, sf_dir), _REGIONS)


@query("absurdity_gate", _with(f"""select offer_key, category, region_id, group_median from (
  select offer_key, o.category, o.region_id, base_minor, m.group_median from o join (select category, region_id, {_MEDIAN("base_minor")} as group_median from o group by category, region_id) m
  on o.category = m.category and o.region_id = m.region_id) where group_median <= 0 or base_minor / group_median between 0.1 and 10"""))
def absurdity_gate(spark, sf_dir):
    return plausibility.absurdity_gate(candidates(spark, sf_dir), "base_minor", "category", "region_id").select("offer_key", "category", "region_id", "group_median")


@query("plausibility_band", _with("select offer_key, case " + " ".join(f"when category = '{c}' and base_minor < {lo} then 'below the plausible band' when category = '{c}' and base_minor > {hi} then 'above the plausible band'" for c, (lo, hi) in plausibility.BANDS.items()) + " end as reason from o"))
def plausibility_band(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_key", plausibility.band_reason(F.col("category"), F.col("base_minor")).alias("reason"))


def _reason_sql() -> str:
    def off(name: str) -> str:
        plain = f"nullif(regexp_extract(title, {_QUOTED(plausibility.words_pattern(plausibility.OFF_TOPIC[name]))}), '')"
        if name not in plausibility.OFF_TOPIC_UNLESS:
            return plain
        own, others = plausibility.OFF_TOPIC_UNLESS[name]
        return f"coalesce({plain}, case when not regexp_matches(title, {_QUOTED(plausibility.words_pattern(own))}) then nullif(regexp_extract(title, {_QUOTED(plausibility.words_pattern(others))}), '') end)"

    words = "case category " + " ".join(f"when '{c}' then {off(c)}" for c in plausibility.OFF_TOPIC) + " end"
    basis = "case when category = 'cement' and size < 20 then 'retail pack of kg ' || size || '.0' when category = 'water_pipes' and (size < 15 or size > 315) then 'bore outside plumbing range: mm ' || size || '.0' end"
    band = "case " + " ".join(f"when category = '{c}' and base_minor < {lo} then 'below the plausible band' when category = '{c}' and base_minor > {hi} then 'above the plausible band'" for c, (lo, hi) in plausibility.BANDS.items()) + " end"
    return f"coalesce('title names another product class: ' || lower(trim({words})), {basis}, {band})"


_QUOTED = lambda p: "'" + p.replace("'", "''") + "'"


def _implausible():
    size = F.col("size").cast("double")  # stands in for the pack and for the bore
    return plausibility.implausible_reason(F.col("category"), F.col("title"), F.lit("piece"), size, size, F.lit(True), F.col("base_minor"))


@query("plausibility_reason", _with(f"select offer_key, {_reason_sql()} as reason from o"))
def plausibility_reason(spark, sf_dir):
    return candidates(spark, sf_dir).select("offer_key", _implausible().alias("reason"))


@query("quarantine_report", _with(f"""select regexp_replace(regexp_replace(reason, ':.*$', ''), '\\d+(\\.\\d+)?', '#', 'g') as family, count(*)::bigint as n, list_sort(list(distinct title))[1:3] as examples from (
  select title, {_reason_sql()} as reason from o) where reason is not null group by family"""))
def quarantine_report(spark, sf_dir):
    return plausibility.quarantine_report(plausibility.quarantine(candidates(spark, sf_dir), _implausible()))


@query("price_bands", None)
def price_bands(spark, sf_dir):
    return surface.price_bands(landed(candidates(spark, sf_dir)))


_Q = "list_sort(list(landed_minor))"
_R = lambda x: f"(case when {x} >= 100000 then floor({x} / 10000.0 + 0.5) * 10000 when {x} >= 10000 then floor({x} / 1000.0 + 0.5) * 1000 else floor({x} / 100.0 + 0.5) * 100 end)::bigint"
ORACLES["price_bands"] = _with(f"""select c.category, len(list_filter(cuts, lambda x: x <= landed_minor))::int as band, null::bigint as low_minor, null::bigint as high_minor, count(*)::bigint as n from l join cc c on l.category = c.category group by all""", f""",
c0 as (select category, {_Q} as v from l group by category),
c1 as (select category, v[1 + least(len(v) - 1, floor(0.25 * len(v))::bigint)] as q1, v[1 + least(len(v) - 1, floor(0.5 * len(v))::bigint)] as q2, v[1 + least(len(v) - 1, floor(0.75 * len(v))::bigint)] as q3 from c0),
cc as (select category, list_filter(list_distinct([{_R("q1")}, {_R("q2")}, {_R("q3")}]), lambda x: x > 0) as cuts from c1)""").replace("null::bigint as low_minor, null::bigint as high_minor", "list_sort(cuts)[len(list_filter(cuts, lambda x: x <= landed_minor))] as low_minor, list_sort(cuts)[len(list_filter(cuts, lambda x: x <= landed_minor)) + 1] as high_minor")

#: Tax in basis points by category, with the days it holds.
_RATES = "('cement', date '1990-01-01', date '1997-12-31', 2800), ('cement', date '1998-01-01', null, 1800), ('tmt_steel', date '1996-06-01', null, 1800), ('water_pipes', date '1990-01-01', null, 1800), ('bricks_blocks', date '1995-01-01', date '1999-06-30', 1200), ('bricks_blocks', date '1999-01-01', null, 600), ('tmt_steel', date '1997-03-01', date '1997-08-31', 1200), ('tmt_steel', date '1997-03-01', date '1997-05-31', 500), ('water_pipes', date '1995-01-01', date '1996-12-31', 2800)"


@query("gst_asof", _with(f"""select offer_key, category, rate from (
  select o.offer_key, o.category, r.rate_bp as rate, row_number() over (partition by o.offer_key, o.vendor_id, o.base_minor order by r.effective_from desc nulls last, coalesce(r.effective_to, date '9999-12-30'), r.rate_bp desc) as n
  from o left join (select * from (values {_RATES}) as r(category, effective_from, effective_to, rate_bp)) r
  on o.category = r.category and o.fetched_at::date >= r.effective_from and o.fetched_at::date <= coalesce(r.effective_to, date '9999-01-01')) where n = 1"""))
def gst_asof(spark, sf_dir):
    """The tax rate in force when the offer was seen; none: null, which refuses the quote."""
    rates = spark.sql(f"select category, effective_from, effective_to, rate_bp as rate from values {_RATES} as r(category, effective_from, effective_to, rate_bp)")
    facts = candidates(spark, sf_dir).select("offer_key", "category", F.to_date("fetched_at").alias("day"))
    return reports.as_of_join(facts, rates, ["category"], "day").select("offer_key", "category", "rate")


_CONVERSIONS = "(1, 'tonne', 'kg', '*', 1000.0), (2, 'bag', 'kg', 'cement', 50.0), (3, 'tonne', 'bag', 'cement', 20.0), (4, 'quintal', 'kg', '*', 100.0), (5, 'foot', 'metre', 'water_pipes', 0.3048)"
_UNIT_SQL = "case size % 6 when 0 then 'tonne' when 1 then 'bag' when 2 then 'kg' when 3 then 'quintal' when 4 then 'foot' else 'piece' end"
_TO_SQL = "case category when 'cement' then 'bag' when 'water_pipes' then 'metre' else 'kg' end"


@query("unit_convert", _with(f"""select t.offer_key, from_unit, to_unit,
  case when from_unit = to_unit then base_minor when size % 10 = 0 then floor(base_minor / 2.5::double + 0.5)::bigint
    when d is not null then floor(base_minor / d + 0.5)::bigint when i is not null then floor(base_minor * i + 0.5)::bigint end as converted,
  case when from_unit = to_unit then 'identity' when size % 10 = 0 then 'sku' when d is not null then 'direct' when i is not null then 'inverse' end as via
from t left join (select f, g, category, arg_min(factor, n) as d from k group by all) a on a.f = from_unit and a.g = to_unit and a.category = t.category
  left join (select f, g, category, arg_min(factor, n) as i from k group by all) b on b.f = to_unit and b.g = from_unit and b.category = t.category""", f""",
t as (select *, {_UNIT_SQL} as from_unit, {_TO_SQL} as to_unit from o),
v as (select n, f, g, c, factor::double as factor from (values {_CONVERSIONS}) as v(n, f, g, c, factor)),
k as (select n, f, g, factor, u.category from v join (select distinct category from o) u on v.c = u.category or v.c = '*')"""))
def unit_convert(spark, sf_dir):
    table_ = spark.sql(f"select position, from_unit, to_unit, category, cast(factor as double) as factor from values {_CONVERSIONS} as c(position, from_unit, to_unit, category, factor)")
    rows = candidates(spark, sf_dir).select("offer_key", F.col("base_minor").alias("amount"), F.expr(_UNIT_SQL).alias("from_unit"), F.expr(_TO_SQL).alias("to_unit"), "category", F.when(F.col("size") % 10 == 0, 2.5).alias("sku_factor"))
    return reports.convert_price(rows, table_).select("offer_key", "from_unit", "to_unit", "converted", "via")


@query("display_join", _with("select offer_key, title, brand, vendor_name, region, base_minor from o where stock_state = 'in_stock' and region = 'ASIA' and category = 'cement'"))
def display_join(spark, sf_dir):
    rows = offers(spark, sf_dir).where("stock_state = 'in_stock'").join(products(spark, sf_dir).where("category = 'cement'"), "product_id").join(vendors(spark, sf_dir).where("region = 'ASIA'"), "vendor_id")
    return rows.select("offer_key", "title", "brand", "vendor_name", "region", "base_minor")


@query("left_lead_time", _with("select offer_key, coalesce(lead_days, s.d)::int as lead from o left join (values (0, 2), (1, 4), (2, 1)) as s(r, d) on region_id = s.r"))
def left_lead_time(spark, sf_dir):
    service = spark.sql("select * from values (0, 2), (1, 4), (2, 1) as s(region_id, lead_days)")
    return surface.lead_time_join(candidates(spark, sf_dir), service).select("offer_key", F.col("lead").cast("int").alias("lead"))


@query("page_semi_join", _with("select offer_key, title, vendor_name from o where offer_key in (select offer_key from o order by base_minor, offer_key limit 24)"))
def page_semi_join(spark, sf_dir):
    """Late materialisation: the page is found on narrow rows, and only its rows get wide."""
    page = offers(spark, sf_dir).select("offer_key", "base_minor").orderBy("base_minor", "offer_key").limit(24).select("offer_key")
    return candidates(spark, sf_dir).join(page, "offer_key", "left_semi").select("offer_key", "title", "vendor_name")


@query("anti_unread", "select page_id, url from pages where not exists (select 1 from documents where doc_id = page_id)")
def anti_unread(spark, sf_dir):
    read = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    return reports.not_in(table(spark, sf_dir, "pages").select("page_id", "url"), read, ["page_id"])


_RUNS = """,
h as (select product_id, region_id, date_trunc('year', fetched_at) as y, min(landed_minor)::bigint as m from l group by all),
a as (select * from h where y = timestamp '1999-01-01'), b as (select * from h where y = timestamp '2000-01-01')"""


@query("run_diff", _with("""select coalesce(a.product_id, b.product_id) as product_id, coalesce(a.region_id, b.region_id) as region_id, a.m as was, b.m as now,
  case when a.m is null then 'appeared' when b.m is null then 'vanished' else 'changed' end as kind, coalesce(abs(b.m - a.m) / a.m::double > 0.03, false) as is_shock
  from a full join b on a.product_id = b.product_id and a.region_id = b.region_id where a.m is null or b.m is null or a.m <> b.m""", _RUNS))
def run_diff(spark, sf_dir):
    rows = landed(candidates(spark, sf_dir)).groupBy("product_id", "region_id", F.year("fetched_at").alias("y")).agg(F.min("landed_minor").alias("m"))
    return reports.run_diff(rows.where("y = 1999"), rows.where("y = 2000"), ["product_id", "region_id"], "m")


@query("correlated_max", """select o_orderkey, (select max(l_quantity) from lineitem where l_orderkey = o_orderkey)::double as most from orders""")
def correlated_max(spark, sf_dir):
    most = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("most"))
    return table(spark, sf_dir, "orders").join(most, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "most")


@query("json_unnest", """select k as key, count(*)::bigint as n, count(distinct v)::bigint as n_values from (
  select unnest(json_keys(props)) as k, json_extract_string(props, '$.' || unnest(json_keys(props))) as v from events) where v is not null and v <> '' group by k""")
def json_unnest(spark, sf_dir):
    return reports.json_keys(table(spark, sf_dir, "events"), "props")


def _scored(spark, sf_dir, *keep: str):
    """Offers' scores in their category and region, with the columns to ``keep``."""
    return _published(ranking.score(_surface(spark, sf_dir), "category", "region", requested=25, keep=list(keep)))


def _published(scored):
    """With the score in millionths and, from these, in thousandths."""
    scored = scored.withColumn("score_e6", ranking.in_units(F.col("score"), 1e6))
    return scored.withColumn("score_e3", F.round(F.col("score_e6") / 1000).cast("bigint"))


@query("rank_score", _with("select offer_key, round(score_e6 / 1000.0)::bigint as score_e3 from r", _FRESH + _SCORE))
def rank_score(spark, sf_dir):
    """The nine-feature score in thousandths."""
    return _scored(spark, sf_dir, "offer_key").select("offer_key", "score_e3")


_RANKED = """,
p as (select *, row_number() over (partition by category, region order by round(score_e6 / 1000.0)::bigint desc, landed_minor, fetched_at desc, offer_key, moq) as rank_pos from r)"""


def _order():
    return [F.desc("score_e3"), F.asc("landed_minor"), F.desc("fetched_at"), F.asc("offer_key"), F.asc("moq")]


def _ranked(spark, sf_dir):
    keep = ["product_id", "offer_key", "vendor_id", "fetched_at", "moq", "quotable"]
    rows = _scored(spark, sf_dir, *keep).select("category", "region", "landed_minor", "score_e3", *keep)
    return ranking.banded(rows, ["category", "region"], -F.col("score_e3"), _order(), "rank_pos", "row_number").drop("_total")


@query("rank_order", _with("select category, region, rank_pos, offer_key from p where rank_pos <= 24", _FRESH + _SCORE + _RANKED))
def rank_order(spark, sf_dir):
    rows = _scored(spark, sf_dir, "offer_key", "fetched_at", "moq")
    place = F.row_number().over(Window.partitionBy("category", "region").orderBy(*_order()))  # a top-k: cut before the shuffle
    return rows.withColumn("rank_pos", place).where("rank_pos <= 24").select("category", "region", "rank_pos", "offer_key")


@query("group_by_product", _with("""select category, region, product_id, min(rank_pos)::int as position, arg_min(offer_key, (not quotable, landed_minor, rank_pos)) as offer_key,
  arg_min(landed_minor, (not quotable, landed_minor, rank_pos))::bigint as landed_minor, count(distinct vendor_id)::bigint as n_sellers, count(*)::bigint as n_offers from p group by category, region, product_id""", _FRESH + _SCORE + _RANKED))
def group_by_product(spark, sf_dir):
    return ranking.by_product(_ranked(spark, sf_dir), "category", "region").withColumn("position", F.col("position").cast("int"))


@query("vendor_rollup", _with("""select product_id, vendor_id, arg_min(offer_key, (stock_state = 'out_of_stock', landed_minor, offer_key)) as offer_key,
  arg_min(landed_minor, (stock_state = 'out_of_stock', landed_minor, offer_key))::bigint as landed_minor, (count(*) - 1)::bigint as also_listed from l group by product_id, vendor_id"""))
def vendor_rollup(spark, sf_dir):
    return ranking.vendor_rollup(landed(candidates(spark, sf_dir)), "product_id")


@query("best_value", _with("""select offer_key, floor(floor((0.5::double * (rank() over g - 1) / greatest(count(*) over (partition by category, region) - 1, 1)
  - 0.3::double * coalesce(case when size % 4 > 0 then (size % 5 + 1)::double end, 3.5) / 5 - case when line_status = 'F' then 0.2::double else 0 end) * 1e9 + 0.5) / 1000 + 0.5)::bigint as value_e6
  from l window g as (partition by category, region order by landed_minor)"""))
def best_value(spark, sf_dir):
    """The price's place, rating and certificate of every offer; sizes and statuses stand in for ratings and certificates."""
    rows = landed(candidates(spark, sf_dir)).withColumns({"rating": F.when(F.col("size") % 4 > 0, (F.col("size") % 5 + 1).cast("double")), "cert_state": F.when(F.col("line_status") == "F", "CERTIFIED")})
    return ranking.best_value(rows.select("category", "region", "offer_key", "landed_minor", "rating", "cert_state"), "category", "region").select("offer_key", F.floor(F.col("value_e9") / 1000 + 0.5).cast("bigint").alias("value_e6"))


_WANTED = {"brand": "Brand#1", "category": "Cement", "size": 10, "_note": "x"}


def _constraint_columns():
    return {"brand": F.col("brand"), "category": F.col("category"), "size": F.when(F.col("size") % 5 != 0, F.lit(None)).otherwise(F.col("size"))}


_HITS = "(lower(trim(brand)) = 'brand#1' or starts_with(lower(trim(brand)), 'brand#1 '))::int as hb, (lower(category) = 'cement')::int as hc, case when size % 5 = 0 then (size = 10)::int end as hs"


@query("constraint_filter", _with(f"select offer_key, (hb + hc + coalesce(hs, 0))::int as matched from (select *, {_HITS} from o) where hb + hc + coalesce(hs, 0) > 0 and hb = 1 and hc = 1 and coalesce(hs, 1) = 1"))
def constraint_filter(spark, sf_dir):
    ok, matched, _ = facets.constraints_match(_WANTED, _constraint_columns())
    return candidates(spark, sf_dir).where(ok).select("offer_key", matched.cast("int").alias("matched"))


_FACET_SQL = {
    "size": {"1 – 10": "size between 1 and 10", "11 – 30": "size between 11 and 30", "Over 30": "size > 30", "8 mm": "abs(size - 8) < 1e-9"},
    "brand": {b: f"lower(brand) = '{b.lower()}'" for b in ("Brand#1", "Brand#2", "Brand#3", "Brand#13")},
    "price": {"Under ₹1,000": "landed_minor / 100.0 < 1000", "Over ₹1,000": "landed_minor / 100.0 > 1000"},
}
_CHOSEN = {"size": ["1 – 10", "Over 30"], "brand": ["Brand#1", "Brand#2"]}


def _facet_defs():
    return {"size": (F.col("size"), list(_FACET_SQL["size"])), "brand": (F.col("brand"), list(_FACET_SQL["brand"])), "price": (F.col("landed_minor") / 100, list(_FACET_SQL["price"]))}


def _facet_sql() -> str:
    fails = {f: "not (" + " or ".join(_FACET_SQL[f][v] for v in _CHOSEN[f]) + ")" for f in _CHOSEN}
    parts = []
    for f, values in _FACET_SQL.items():
        others = " and ".join(["true"] + [f"not ({x})" for g, x in fails.items() if g != f])
        parts += [f"select '{f}' as facet, '{v}' as value, count(distinct product_id) filter (({others}) and ({w}))::bigint as n from l" for v, w in values.items()]
    return _with(" union all ".join(parts))


@query("facet_counts", _facet_sql())
def facet_counts(spark, sf_dir):
    """All leave-one-out counts in one aggregate."""
    return facets.facet_counts(landed(candidates(spark, sf_dir)), _facet_defs(), _CHOSEN)


@query("facet_select", _with("select count(distinct product_id)::bigint as n_products, count(*)::bigint as n_offers from l where " + " and ".join("(" + " or ".join(_FACET_SQL[f][v] for v in _CHOSEN[f]) + ")" for f in _CHOSEN)))
def facet_select(spark, sf_dir):
    return facets.select_facets(landed(candidates(spark, sf_dir)), _facet_defs(), _CHOSEN).agg(F.countDistinct("product_id").alias("n_products"), F.count("*").alias("n_offers"))


_LADDER = {"brand": "Brand#1", "category": "none such", "size": 10}


@query("zero_result_rung", _with("""select 1 as rung, n from (select count(*)::bigint as n from (select *, (lower(category) = 'none such')::int as hc, case when size % 5 = 0 then (size = 10)::int end as hs, (lower(brand) = 'brand#1')::int as hb from o) where 1 = 0)
  where n > 0 union all select 2 as rung, count(*)::bigint as n from o where size % 5 = 0 and size = 10"""))
def zero_result_rung(spark, sf_dir):
    return facets.zero_result_rung(candidates(spark, sf_dir), _LADDER, _constraint_columns(), ["brand", "category", "size"])


def _sorted_nulls_last(descending: bool):
    by = "desc" if descending else "asc"

    @query(f"sort_nulls_last_{by}", _with(f"select category, region, offer_key, row_number() over (partition by category, region order by lead_days {by} nulls last, offer_key, base_minor) as place from o"))
    def run(spark, sf_dir):
        """All offers, within their category and region."""
        rows = candidates(spark, sf_dir).select("category", "region", "offer_key", "lead_days", "base_minor")
        ordered = ranking.placed(rows, ["category", "region"], ranking.column_order("lead_days", descending, "offer_key", "base_minor"))
        return ordered.select("category", "region", "offer_key", F.col("place").cast("bigint").alias("place"))


_sorted_nulls_last(False)
_sorted_nulls_last(True)


@query("top_k", _with("select offer_key, landed_minor from l order by landed_minor, offer_key limit 100"))
def top_k(spark, sf_dir):
    return landed(candidates(spark, sf_dir)).select("offer_key", "landed_minor").orderBy("landed_minor", "offer_key").limit(100)


@query("page_offset", _with("select offer_key, landed_minor from l order by landed_minor, offer_key limit 24 offset 48"))
def page_offset(spark, sf_dir):
    return landed(candidates(spark, sf_dir)).select("offer_key", "landed_minor").orderBy("landed_minor", "offer_key").offset(48).limit(24)


_TERMS = ["tion", "license", "the"]
_TOK = r"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{M}\p{N}]+'), lambda t: t <> '')"
_BM25 = f"""ix as (select doc_id, term, count(*)::double as f from (select doc_id, unnest({_TOK}) as term from documents) group by all),
len as (select doc_id, sum(f) as dl from ix group by doc_id), tot as (select count(*)::double as n, avg(dl) as al from len),
qf as (select doc_id, q, sum(f) as f from ix join (values {", ".join(f"('{t}')" for t in _TERMS)}) as q(q) on starts_with(term, q) group by doc_id, q),
df as (select q, count(*)::double as df from qf group by q),
bm as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / al))), 6) as score from qf join df using (q) join len using (doc_id) cross join tot group by doc_id)"""


def _lexical(spark, sf_dir):
    return retrieval.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, _TERMS, top=None)


@query("bm25_topk", f"with {_BM25} select doc_id, round(score, 3) as score from bm order by round(score, 3) desc, doc_id limit 50")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("doc_id", F.round("score", 3).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


_SUB = "sub as (select doc_id, " + " + ".join(f"((length(low) - length(replace(low, '{t}', ''))) / {len(t)})::int" for t in _TERMS) + " as score from (select doc_id, lower(coalesce(text, '')) as low from documents))"


@query("substring_match", f"with {_SUB} select doc_id, score::double as score from sub where score > 0")
def substring_match(spark, sf_dir):
    return retrieval.substring_scores(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS, top=None)


@query("score_fusion", f"""with {_BM25}, {_SUB}, a as (select min(score) as lo, max(score) as hi from bm), b as (select min(score) as lo, max(score) as hi from sub where score > 0)
select coalesce(bm.doc_id, s.doc_id) as doc_id, round(0.75 * coalesce((bm.score - a.lo) / case when a.hi = a.lo then 1 else a.hi - a.lo end, 0) + 0.25 * coalesce((s.score - b.lo) / case when b.hi = b.lo then 1 else b.hi - b.lo end, 0), 4) as relevance
from bm full join (select * from sub where score > 0) s on bm.doc_id = s.doc_id cross join a cross join b""")
def score_fusion(spark, sf_dir):
    return retrieval.fuse(_lexical(spark, sf_dir), retrieval.substring_scores(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS, top=None), "doc_id").select("doc_id", F.round("relevance", 4).alias("relevance"))


@query("trending", "select event_type as q, count(*)::bigint as n, max(ts) as latest from events where value > 5 group by event_type order by n desc, latest desc, q limit 6")
def trending(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("q"), F.when(F.col("value") > 5, 1).otherwise(0).alias("hits"), F.col("ts").alias("at"))
    return retrieval.trending(log)


@query("intent_chips", _with("select category, count(distinct product_id)::bigint as n from o where contains(lower(title), 'red') group by category"))
def intent_chips(spark, sf_dir):
    rows = candidates(spark, sf_dir).where(retrieval.contains(F.col("title"), "red"))
    return rows.groupBy("category").agg(F.countDistinct("product_id").alias("n"))


@query("suggest", _with("select product_id, title, min(landed_minor)::bigint as landed_minor from l where contains(lower(title), 'bo') group by product_id, title order by landed_minor, product_id limit 8"))
def suggest(spark, sf_dir):
    return retrieval.suggest(landed(candidates(spark, sf_dir)), "bo")


_FORMS = ["cement", "steel", "tension", "nation", "there", "license", "thing"]


@query("levenshtein_correct", f"""with w as (select distinct unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: length(t) >= 4)) as word from documents),
v as (select * from (values {", ".join(f"({i}, '{f}')" for i, f in enumerate(_FORMS))}) as v(priority, form)),
m as (select word, form, priority, levenshtein(word, form)::int as distance from w cross join v where levenshtein(word, form) between 1 and 2)
select word, form, distance from (select *, row_number() over (partition by word order by distance, priority, form) as n from m) where n = 1""")
def levenshtein_correct(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    forms = spark.sql(f"select * from values {', '.join(f'({i}, {chr(39)}{f}{chr(39)})' for i, f in enumerate(_FORMS))} as v(priority, form)")
    return retrieval.correct_words(words, forms)


@query("fnv_fallback_km", """select s_suppkey, 6 + (list_reduce([2166136261] || list_transform(string_split('v_' || sha1(s_name), ''), lambda c: ascii(c)::bigint),
  lambda h, c: (xor(h::bigint, c::bigint) * 16777619) & 4294967295) % 3601) / 100.0::double as km from supplier""")
def fnv_fallback_km(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", freight.fallback_km(F.concat(F.lit("v_"), F.sha1("s_name"))).alias("km"))


@query("haversine_freight", _with("select distinct vendor_id, round(km, 2) as km, case when km <= 15 then 'local' when km <= 40 then 'metro' when km <= 100 then 'regional' when km <= 250 then 'inter_city' else 'long_haul' end as band from l"))
def haversine_freight(spark, sf_dir):
    km = freight.road_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    sold = offers(spark, sf_dir).select("vendor_id").distinct()
    return vendors(spark, sf_dir).join(sold, "vendor_id", "left_semi").select("vendor_id", F.round(km, 2).alias("km"), freight.distance_band(km).alias("band"))


@query("html_frontier", r"""select distinct url from (select unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as url from pages) where regexp_matches(url, '^/[a-z]')""")
def html_frontier(spark, sf_dir):
    return listings.links(table(spark, sf_dir, "pages"), "^/[a-z]")


@query("url_parts", r"""select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("HOST")).alias("host"), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")).alias("path"))


@query("title_over_merge", """select p_brand as brand, count(distinct trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')))::bigint as n_titles from part group by p_brand having count(distinct trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) > 1 order by n_titles desc, brand limit 8""")
def title_over_merge(spark, sf_dir):
    return reports.over_merged(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand"), "brand", "p_name")


@query("brand_tokens", r"""select token, count(*)::bigint as n, min(t) as example from (
  select unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')))) as token, text[1:60] as t from documents) where lower(token) not in ('the', 'that') group by token order by n desc, token limit 40""")
def brand_tokens(spark, sf_dir):
    return reports.brand_tokens(table(spark, sf_dir, "documents"), "text", ["the", "that"])


@query("freshness_histogram", f"""select count(*) filter (a < 24)::bigint as under_24h, count(*) filter (a >= 24 and a < 72)::bigint as under_72h, count(*) filter (a >= 72 and a < 168)::bigint as under_168h,
  count(*) filter (a >= 168)::bigint as older, count(*)::bigint as total from (select (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3600000000.0 as a from events)""")
def freshness_histogram(spark, sf_dir):
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000.0
    return reports.freshness_histogram(table(spark, sf_dir, "events").select(age.alias("age_hours")))


@query("cart_totals", """select l_orderkey as cart, sum(q * u)::bigint as gross_minor, sum(floor(q * u * r / (r + 10000)::double + 0.5))::bigint as tax_minor, sum(q)::bigint as units, count(*)::bigint as n_lines,
  (sum(q * u) - sum(floor(q * u * r / (r + 10000)::double + 0.5)))::bigint as net_minor from (
  select l_orderkey, l_quantity::bigint as q, floor(l_extendedprice * 100 / l_quantity + 0.5)::bigint as u, floor(l_tax * 10000 + 0.5)::bigint as r from lineitem) where q > 0 and u > 0 group by l_orderkey""")
def cart_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cart"), F.col("l_quantity").cast("bigint").alias("quantity"), money.half_up(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("unit_minor"), money.half_up(F.col("l_tax") * 10_000).alias("rate_bp"))
    return pricing.cart_totals(lines, "cart")


@query("bulk_quote", _with("""select l_orderkey as order_id, count(*)::bigint as n_lines, count(*) filter (u is null)::bigint as n_blocked, coalesce(sum(u * l_quantity::bigint), 0)::bigint as total_minor
  from lineitem left join (select product_id, min(landed_minor) as u from g where quotable and stock_state = 'in_stock' group by product_id) b on l_partkey = b.product_id group by l_orderkey""", _FRESH))
def bulk_quote(spark, sf_dir):
    quotes = _surface(spark, sf_dir).withColumn("blocked", F.when(~F.col("quotable"), "PRICE_EXPIRED").when(F.col("stock_state") == "out_of_stock", "OUT_OF_STOCK")).withColumnRenamed("landed_minor", "unit_minor")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return pricing.bulk_quote(lines, quotes, "order_id")


def _rounded(df: DataFrame, key: str, parts: dict, names: list[str]) -> DataFrame:
    return df.select(key, *((F.round(parts[n], 3) if not n.startswith(("buy", "low_rods", "high_rods", "lengths")) else parts[n]).alias(n) for n in names))


@query("estimate_concrete", """select p_partkey, round(bags, 3) as cement_bags, ceil(round(bags, 9))::bigint as buy_bags, round(dry * 1.5 / 5.5 * 35.3147, 3) as sand_cft, round(dry * 3 / 5.5 * 35.3147, 3) as aggregate_cft
  from (select p_partkey, dry, dry * 1 / 5.5::double * 1440 / 50 as bags from (select p_partkey, p_size::double * 1.54::double * (1 + 0.03::double) as dry from part))""")
def estimate_concrete(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "part"), "p_partkey", estimate.concrete(F.col("p_size").cast("double"), F.lit("M20")), ["cement_bags", "buy_bags", "sand_cft", "aggregate_cft"])


@query("estimate_masonry", """select p_partkey, round(net * 500.0::double, 3) as units_raw, round(net * pm * 1.05::double, 3) as units from (
  select p_partkey, p_size::double * 0.19::double as net, 1 / (0.2::double * 0.1 * 0.1) as pm from part)""")
def estimate_masonry(spark, sf_dir):
    area = F.col("p_size").cast("double")
    m = estimate.masonry(area, F.lit("clay_modular_190"), F.lit("cm_1_6"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(area * 0.19 * m["units_per_m3"], 3).alias("units_raw"), F.round(m["units"], 3).alias("units"))


@query("estimate_steel_band", """select p_partkey, round(p_size * 50 * 1.03::double, 3) as low_kg, round(p_size * 90 * 1.03::double, 3) as high_kg, (ceil(round(p_size * 50 * 1.03::double / 10, 9)) * 10)::bigint as buy_kg from part""")
def estimate_steel_band(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "part"), "p_partkey", estimate.steel(F.col("p_size").cast("double"), F.lit("slab")), ["low_kg", "high_kg", "buy_kg"])


@query("estimate_pipe", "select p_partkey, round(p_size * 1.05::double, 3) as metres, ceil(round(p_size * 1.05::double / 3, 9))::bigint as lengths from part")
def estimate_pipe(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "part"), "p_partkey", estimate.pipe(F.col("p_size").cast("double")), ["metres", "lengths"])


@query("price_tails", _with("""select category, region, tail, place, offer_key, landed_minor from (
  select category, region, 'low' as tail, row_number() over (partition by category, region order by landed_minor, offer_key) as place, offer_key, landed_minor from l
  union all select category, region, 'high' as tail, row_number() over (partition by category, region order by landed_minor desc, offer_key) as place, offer_key, landed_minor from l) where (tail = 'low' and place <= 5) or (tail = 'high' and place <= 4)"""))
def price_tails(spark, sf_dir):
    return reports.price_tails(landed(candidates(spark, sf_dir)))


@query("region_parity", _with(f"""select category, one, two, case when two > 0 then one / two between 0.5 and 2 end as in_parity from (
  select category, {_MEDIAN("landed_minor", " filter (region = 'ASIA')")} as one, {_MEDIAN("landed_minor", " filter (region = 'EUROPE')")} as two from l where region in ('ASIA', 'EUROPE') group by category)"""))
def region_parity(spark, sf_dir):
    return reports.region_parity(landed(candidates(spark, sf_dir)), "ASIA", "EUROPE")


@query("field_coverage", """select 'lang' as field, count(*) filter (trim(lang) <> '')::bigint as filled, count(*)::bigint as total from documents
  union all select 'text', count(*) filter (trim(text) <> ''), count(*) from documents union all select 'source', count(*) filter (trim(source) <> ''), count(*) from documents""")
def field_coverage(spark, sf_dir):
    return reports.field_coverage(table(spark, sf_dir, "documents"), ["lang", "text", "source"])


@query("latest_per_key", """select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1""")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return reports.latest_per_key(rows, ["user_id"], "ts", "event_id")


@query("keyed_upsert", """select coalesce(a.user_id, b.user_id) as user_id, coalesce(b.v, a.v) as value_minor, coalesce(a.t, b.t) as event_type from
  (select user_id, max(floor(value * 100)::bigint) as v, min(event_type) as t from events where ts < timestamp '2024-01-15' group by user_id) a full join
  (select user_id, max(floor(value * 100)::bigint) as v, min(event_type) as t from events where ts >= timestamp '2024-01-15' group by user_id) b on a.user_id = b.user_id""")
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    agg = lambda df: df.groupBy("user_id").agg(F.max(F.floor(F.col("value") * 100).cast("bigint")).alias("value_minor"), F.min("event_type").alias("event_type"))
    return reports.keyed_upsert(agg(rows.where("ts < timestamp'2024-01-15'")), agg(rows.where("ts >= timestamp'2024-01-15'")), ["user_id"], {"value_minor": "prefer_new", "event_type": "prefer_old"})


@query("compare_set", _with("""select category, true as comparable, low_minor, high_minor, high_minor - low_minor as spread_minor, floor((high_minor - low_minor) * 10000 / low_minor::double + 0.5)::bigint as spread_bp from (
  select category, min(landed_minor)::bigint as low_minor, max(landed_minor)::bigint as high_minor from l group by category)"""))
def compare_set(spark, sf_dir):
    return pricing.compare_set(landed(candidates(spark, sf_dir)).withColumn("unit", F.lit("piece")), "category")


_SCOPE = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_FOLDED = r"' ' || trim(regexp_replace(replace(replace(lower(t), '’', ''''), '''re', ' are'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) || ' '"
_ANY = lambda rules: "regexp_matches(w, '" + "|".join(rules) + "')"


@query("scope_gate", f"""select conv_id, turn, case when t = '' then 'EMPTY' when {_ANY(grounding.UNSAFE_RULES)} then 'UNSAFE'
  when {_ANY((*grounding.ATTACK_RULES, grounding.whole(grounding.PARTS)))} or regexp_matches(t, '{grounding.control_mark()}') then 'INJECTION' when regexp_matches(t, '{grounding.NON_LATIN}') then 'ALLOW'
  when not {_ANY(grounding.DOMAIN_RULES)} and not contains(t, '₹') and len(string_split(t, ' ')) >= 4 then 'OFF_TOPIC' else 'ALLOW' end as verdict from (select *, {_FOLDED} as w from (select conv_id, turn, {_SCOPE} as t from conversations))""")
def scope_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", grounding.scope(F.col("text")).alias("verdict"))


@query("ground_numbers", None)
def ground_numbers(spark, sf_dir):
    """Numbers of every text that no number of the first document of its source comes near: the gate
    that a draft's numbers pass, over all documents. Brute force stands in for SQL, which lacks look-around."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    known = docs.join(first, ["source", "doc_id"], "left_semi").select("source", F.explode(grounding.numbers(F.col("text"))).alias("value"))
    return grounding.ungrounded_numbers(docs, grounding.ledger(known, "source", "value"), "source", "text").distinct()


@query("event_tumbling", "select time_bucket(interval '1 day', ts) as start, event_type, count(*)::bigint as n, sum(floor(value * 100 + 0.5)::bigint)::bigint as value_minor from events group by all")
def event_tumbling(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"))


@query("event_sliding", "select s as start, count(*)::bigint as n from (select unnest([time_bucket(interval '1 day', ts), time_bucket(interval '1 day', ts) - interval '1 day']) as s from events) group by s")
def event_sliding(spark, sf_dir):
    return streams.sliding(table(spark, sf_dir, "events"))


@query("event_session", """with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events),
b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*)::bigint as n from b group by user_id, s""")
def event_session(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


@query("token_bucket", """with recursive e as (select user_id, event_id, ts, epoch_us(ts) / 1000000.0::double as s, row_number() over (partition by user_id order by ts, event_id) as n from events),
b(user_id, event_id, ts, n, s, allowed, tokens) as (
  select user_id, event_id, ts, n, s, true, 7.0::double from e where n = 1
  union all
  select e.user_id, e.event_id, e.ts, e.n, e.s, had >= 1, case when had >= 1 then had - 1 else had end from (
    select e.*, least(8.0::double, b.tokens + greatest(0.0::double, e.s - b.s) * 0.5::double) as had from b join e on e.user_id = b.user_id and e.n = b.n + 1) e)
select user_id, event_id, ts, allowed, floor(tokens * 1000 + 0.5)::bigint as tokens_milli from b""")
def token_bucket(spark, sf_dir):
    return streams.token_bucket(table(spark, sf_dir, "events"))


@query("latest_run", "select o_orderkey, o_orderstatus, o_orderdate from orders where o_orderstatus in ('O', 'P') order by o_orderdate desc, o_orderkey desc limit 1")
def latest_run(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderdate").isNotNull()).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("substitutes", _with("""select category, region, product_id, place, other, gap from (
  select a.category, a.region, a.product_id, b.product_id as other, abs(a.m - b.m)::bigint as gap, row_number() over (partition by a.category, a.region, a.product_id order by abs(a.m - b.m), b.product_id) as place
  from s a join s b on a.category = b.category and a.region = b.region and a.product_id <> b.product_id) where place <= 6""", """,
s as (select category, region, product_id, min(landed_minor)::bigint as m from l group by all)"""))
def substitutes(spark, sf_dir):
    """Every product of every category and region."""
    rows = landed(candidates(spark, sf_dir)).groupBy("category", "region", "product_id").agg(F.min("landed_minor").alias("floor_minor"))
    return reports.substitutes(rows)


@query("indian_money", "select p_partkey, '₹' || case when length(r) > 3 then r[:length(r) - 3] || ',' || r[length(r) - 2:] else r end || '.00' as text from (select p_partkey, (p_partkey % 99999)::varchar as r from part)")
def indian_money(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", money.format_minor(F.col("p_partkey") % 99_999 * 100).alias("text"))


@query("type_guide", _with("""select category, min(landed_minor)::bigint as low_minor, max(landed_minor)::bigint as high_minor, count(*)::bigint as n_offers, count(distinct vendor_id)::bigint as n_vendors,
  list_sort(list(landed_minor))[1 + len(list(landed_minor)) // 2] as element_median from l group by category"""))
def type_guide(spark, sf_dir):
    return quality.type_guide(landed(candidates(spark, sf_dir)), "category", "landed_minor")


@query("quality_rank", _with("""select product_id, category, quality_bp, row_number() over (partition by category order by quality_bp desc, product_id) as place from (
  select product_id, category, floor((size / 50.0::double * 0.40::double + case when c > 0 then 1.0::double else 0.3::double end * 0.25::double + (brand <> 'Brand#1')::int * 0.15::double
    + n::double / max(n) over (partition by category) * 0.20::double) * 10000 + 0.5)::bigint as quality_bp from (
  select product_id, category, size, brand, count(distinct vendor_id) as n, count(*) filter (line_status = 'F') as c from o group by all))"""))
def quality_rank(spark, sf_dir):
    """Products by grade, certification, brand and breadth of supply; sizes and statuses stand in."""
    own = candidates(spark, sf_dir).groupBy("product_id", "category", "size", "brand").agg(F.countDistinct("vendor_id").alias("n"), F.count_if(F.col("line_status") == "F").alias("c"))
    most = own.groupBy("category").agg(F.max("n").alias("most"))
    score = quality.quality(F.col("size") / 50, F.when(F.col("c") > 0, 1.0).otherwise(0.3), F.col("brand") != "Brand#1", F.col("n") / F.col("most"))
    scored = own.join(most, "category").select("product_id", "category", score.alias("quality_bp"))
    ordered = ranking.placed(scored, ["category"], [F.desc("quality_bp"), F.asc("product_id")])
    return ordered.select("product_id", "category", "quality_bp", F.col("place").cast("bigint").alias("place"))
