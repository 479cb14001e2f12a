"""The offer, product, vendor and destination views that the engine works on.

The driver's star schema stands in for collected listings: a line item is an
offer, a part its product, a supplier its vendor, the supplier's region the
destination. Everything here is a projection or an equi-join; Spark's own size
check decides what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import freight, money

AS_OF = "2001-12-01"
#: p_type -> the category whose logistics and bands apply.
CATEGORY = {"ECONOMY": "cement", "SMALL": "tmt_steel", "MEDIUM": "water_pipes", "LARGE": "bricks_blocks", "STANDARD": "cement_white", "PROMO": "other"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each offer, typed, with integer money."""
    return table(spark, sf_dir, "lineitem").select(*_offer())


def _offer() -> list[Column]:
    """An offer's columns, of a line item's."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.floor(F.col("l_extendedprice") * 100).cast("string"))
    return [
        key.alias("offer_key"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("vendor_id"),
        money.half_up(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("base_minor"),
        money.half_up(F.col("l_tax") * 10_000).alias("rate_bp"),
        F.col("l_shipdate").alias("fetched_at"),
        F.col("l_quantity").cast("bigint").alias("moq"),
        F.when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("in_stock").alias("stock_state"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("lead_days"),
        F.col("l_linestatus").alias("line_status"),
    ]


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.col("p_type")
    mapped = F.lit("other")
    for kind, name in CATEGORY.items():
        mapped = F.when(category == kind, F.lit(name)).otherwise(mapped)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), mapped.alias("category"), F.col("p_size").alias("size"))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with the region that they sell to, and both ends of the road."""
    return _placed(table(spark, sf_dir, "supplier"), spark, sf_dir).select(*_vendor())


def _placed(suppliers: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of suppliers with their nation and region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def _vendor() -> list[Column]:
    """A vendor's columns, of a supplier's with its nation and region."""
    return [
        F.col("s_suppkey").alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        F.col("r_regionkey").alias("region_id"),
        F.col("r_name").alias("region"),
        (10 + F.col("n_nationkey") * 0.5).alias("lat"),
        (75 + F.col("n_nationkey") * 0.4).alias("lon"),
        (12 + F.col("r_regionkey") * 1.0).alias("to_lat"),
        (76 + F.col("r_regionkey") * 1.0).alias("to_lon"),
    ]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offer ⋈ product ⋈ vendor.

    Tables are joined one by one, since Spark takes a joined table for as large as the product of both and
    would shuffle the offers for it. What offers are made of is narrower than they are, so they are made last.
    """
    line = table(spark, sf_dir, "lineitem")
    goods = products(spark, sf_dir)
    wide = line.join(goods, F.col("l_partkey") == goods["product_id"]).drop("product_id").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _placed(wide, spark, sf_dir).select(*_offer(), *(c for c in goods.columns if c != "product_id"), *_vendor()[1:])


def landed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``candidates`` with every part of the landed price."""
    km = freight.road_km(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    rows = rows.withColumn("km", km)
    quantity = F.greatest(F.col("moq").cast("double"), freight.logistics(F.col("category"), 3).cast("double"))
    d = freight.delivery(F.col("km"), F.col("category"), F.col("size").cast("double"), quantity)
    rows = rows.withColumns({"gst_minor": money.tax_on(F.col("base_minor"), F.col("rate_bp")), "freight_minor": d.freight, "handling_minor": d.handling, "loading_minor": d.loading, "vehicle": d.vehicle, "band": d.band})
    return rows.withColumn("landed_minor", F.expr("base_minor + gst_minor + freight_minor + handling_minor + loading_minor"))


def _case(column: str, pairs, otherwise: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in pairs) + f" else {otherwise} end"


_q = "greatest(moq::double, " + _case("category", [(k, v[3]) for k, v in freight.LOGISTICS.items()], "50") + ")"
_kg = "(size::double * q)"
_by_kg = lambda i: "case " + " ".join(f"when kg <= {v[1]} then {v[i]}" for v in freight.VEHICLES[:-1]) + f" else {freight.VEHICLES[-1][i]} end"
_cls = "case " + " ".join(f"when kg <= {v[1]} then '{v[0]}'" for v in freight.VEHICLES[:-1]) + f" else '{freight.VEHICLES[-1][0]}' end"
_log = lambda i: _case("category", [(k, v[i]) for k, v in freight.LOGISTICS.items()], str(freight.LOGISTICS["cement"][i]))

#: The same views for DuckDB: o (candidates) and l (with landed prices).
SQL = f"""
o as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), floor(l_extendedprice * 100)::bigint) as offer_key,
    l_partkey as product_id, l_suppkey as vendor_id, floor(l_extendedprice * 100 / l_quantity + 0.5)::bigint as base_minor,
    floor(l_tax * 10000 + 0.5)::bigint as rate_bp, l_shipdate as fetched_at, l_quantity::bigint as moq,
    case when l_returnflag = 'R' then 'out_of_stock' else 'in_stock' end as stock_state,
    case when l_linenumber < 7 then l_linenumber end as lead_days, l_linestatus as line_status,
    p_name as title, p_brand as brand, {_case("p_type", [(k, f"'{v}'") for k, v in CATEGORY.items()], "'other'")} as category, p_size as size,
    s_name as vendor_name, r_regionkey as region_id, r_name as region,
    10 + n_nationkey * 0.5::double as lat, 75 + n_nationkey * 0.4::double as lon, 12 + r_regionkey * 1.0::double as to_lat, 76 + r_regionkey * 1.0::double as to_lon
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
l0 as (select *, floor(2 * 6371.0::double * asin(sqrt(least(1.0, sin(radians(to_lat - lat) / 2) * sin(radians(to_lat - lat) / 2)
    + cos(radians(lat)) * cos(radians(to_lat)) * sin(radians(to_lon - lon) / 2) * sin(radians(to_lon - lon) / 2)))) * 1.32::double * 100 + 0.5) / 100 as km, {_q} as q from o),
l1 as (select *, {_kg} as kg from l0),
l2 as (select *, greatest(1, ceil(kg / {_by_kg(1)}))::bigint as trips, {_cls} as vehicle from l1),
l3 as (select *, case when vehicle = 'parcel' then 8000 + floor(kg * 600 + 0.5)::bigint else greatest(floor(km * {_by_kg(2)} + 0.5)::bigint, {_by_kg(3)}) * trips end as cost from l2),
l as (select *, floor(base_minor * rate_bp / 10000::double + 0.5)::bigint as gst_minor, floor(cost / q + 0.5)::bigint as freight_minor,
    floor(greatest({_log(2)}, floor(kg * {_log(1)} + 0.5)::bigint) / q + 0.5)::bigint as handling_minor, ({_log(0)})::bigint as loading_minor,
    floor(base_minor * rate_bp / 10000::double + 0.5)::bigint + floor(cost / q + 0.5)::bigint + base_minor
    + floor(greatest({_log(2)}, floor(kg * {_log(1)} + 0.5)::bigint) / q + 0.5)::bigint + ({_log(0)})::bigint as landed_minor from l3)
"""
