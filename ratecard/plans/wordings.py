"""Queries of the scalar functions on texts that sellers and buyers write, each with its SQL for DuckDB.

The texts are composed from rows of the tables, in as many wordings as a key has
remainders, so that what each should be read as follows from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import freshness, labels, money, units
from .catalogue import query
from .offers import table


def _one_of(key: str, texts):
    """The text of a row's remainder."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def _sql_one_of(key: str, values) -> str:
    quoted = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {quoted(v)}" for i, v in enumerate(values)) + " end"


@query("rupee_texts", """select p_partkey, case p_partkey % 6 when 0 then p_partkey * 100 + p_size when 1 then p_partkey * 100000 + 500 when 2 then p_partkey * 100 + p_size % 10 * 10 when 3 then p_partkey * 100 end::bigint as minor,
  coalesce(floor(p_size * 100.0 / nullif(p_partkey % 3, 0) * 10 + 0.5), 0)::bigint as tenths, greatest(ceil(p_size / 2.0), p_size * 7)::bigint as quantity
  from part""")
def rupee_texts(spark, sf_dir):
    """Prices as sellers write them, shares in percent, and quantities held to a minimum order."""
    key, size = F.col("p_partkey").cast("string"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    texts = [F.concat(F.lit("Rs. "), key, F.lit("."), size), F.concat(F.lit("₹ "), key, F.lit(",005.00")), F.concat(key, F.lit("."), F.substring(size, 2, 1)), F.concat(F.lit("rs"), key), F.concat(key, F.lit(".125")), F.lit("Ask Price")]
    text = F.element_at(F.array(*texts), (F.col("p_partkey") % 6 + 1).cast("int"))
    share = money.percent(F.col("p_size").cast("double"), (F.col("p_partkey") % 3).cast("double"))
    least = F.col("p_size") / 2
    return table(spark, sf_dir, "part").select("p_partkey", money.minor_from_rupee_text(text).alias("minor"), F.floor(share * 10 + 0.5).cast("bigint").alias("tenths"), money.clamp_quantity(F.col("p_size") * 7, least).alias("quantity"))


_UNITS = ["per Bag", "/kg", "Tonne", "per piece", "Feet", "m3", "cft", "sq ft", "1000 bricks", "coil", "8000 pieces", "MT", "", "bag of 50 kg", "Running Metre", "dozen"]
_UNIT_OF = ["bag", "kg", "tonne", "piece", "running_metre", "cum", "cft", "sqft", "per_1000", "coil", None, "tonne", None, "bag", "running_metre", None]
_FACTOR = [1, 1, 1, 1, 3280840, 1, 1, 1, 1, 1, None, 1, None, 1, 1, None]


@query("quoted_units", f"select p_partkey, {_sql_one_of('p_partkey', _UNIT_OF)} as unit, ({_sql_one_of('p_partkey', [f and (f if f > 1 else 1_000_000) for f in _FACTOR])})::bigint as factor_e6 from part")
def quoted_units(spark, sf_dir):
    """The unit that a quote is for, and how many canonical ones it holds."""
    rows = table(spark, sf_dir, "part").select("p_partkey", units.normalise_unit(_one_of("p_partkey", _UNITS)).alias("u"))
    return rows.select("p_partkey", F.col("u.unit").alias("unit"), F.round(F.col("u.factor") * 1e6).cast("bigint").alias("factor_e6"))


_INCHES = ['1/2"', "¾ inch", "1", '1 1/2"', "2.5", "4 in", "7", '1½"', "0.5"]
_BORES = [15, 20, 25, 40, 75, 110, None, 40, 15]
_KG = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 16: 1.578, 20: 2.466, 25: 3.854, 28: 4.834, 32: 6.313, 36: 7.99, 40: 9.864}


@query("sizes_and_masses", f"""with d as (select p_partkey, p_size + (p_partkey % 10) / 16.0 as mm from part), k as (select * from (values {", ".join(f"({a}, {b}::double)" for a, b in _KG.items())}) as k(mm, kg)),
near as (select p_partkey, arg_min(kg, k.mm) as kg from d join k on abs(k.mm - d.mm) <= 0.6 group by p_partkey)
select p.p_partkey, ({_sql_one_of('p.p_partkey', _BORES)})::int as bore_mm, floor(kg * 12 * 1000 + 0.5)::bigint as rod_grams,
  case p.p_partkey % 5 when 0 then p.p_partkey * 50 when 1 then floor(p.p_partkey / 20.0 + 0.5) when 2 then floor(p.p_partkey / 2.0 + 0.5) when 3 then floor(p.p_partkey * 50.0 / p_size + 0.5) end::bigint as bag_minor from part p left join near using (p_partkey)""")
def sizes_and_masses(spark, sf_dir):
    """Bores of sizes in inches, masses of rods of the nearest standard diameter, and cement by the bag."""
    unit = _one_of("p_partkey", ["kg", "tonne", "quintal", "bag", "litre"])
    mm = F.col("p_size") + (F.col("p_partkey") % 10) / 16
    rod = units.rod_kg(mm, F.lit(12.0))
    return table(spark, sf_dir, "part").select("p_partkey", units.bore_mm(_one_of("p_partkey", _INCHES)).alias("bore_mm"), money.half_up(rod * 1000).alias("rod_grams"), units.cement_bag_price(F.col("p_partkey"), unit, F.col("p_size")).alias("bag_minor"))


@query("texts_normalised", r"""select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as loose, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as squashed,
  try_cast(nullif(regexp_extract(replace(text, ',', ''), '-?\d+(\.\d+)?'), '') as double) as first_number, md5(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as decoded from documents""")
def texts_normalised(spark, sf_dir):
    """Whole texts as they are compared: loosened, squashed, decoded, and their first number."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(units.loosen(text)).alias("loose"), F.md5(units.squash(text)).alias("squashed"), units.number_in(text).alias("first_number"), F.md5(units.entities_decoded(text)).alias("decoded"))


@query("query_wordings", """select p_partkey, p_name || ' ' || p_size || ' mm x ' || p_size || ' kg "' || '53 grade' as asked from part""")
def query_wordings(spark, sf_dir):
    """What buyers type, in one form: case, quotes, signs, spaces, and units that are fused to numbers."""
    typed = F.concat(F.lit("  "), F.upper("p_name"), F.lit("  "), F.col("p_size").cast("string"), F.lit("MM × "), F.col("p_size").cast("string"), F.lit("Kg  ”53grade "))
    return table(spark, sf_dir, "part").select("p_partkey", units.normal_query(typed).alias("asked"))


_MADE = ["Made in India", "INDIA.", "Porbandar,India", "germany", "x", "made in sri lanka"]
_COUNTRY = ["India", "India", "India", "Germany", None, "Sri Lanka"]
_WALLS = ["wall below DPC", "compound wall 5 feet", "load-bearing wall", "partition", "heat outside", "wall", "Insulated external walls", "non-load wall"]
_DUTY = ["below_dpc", "compound_wall", "load_bearing", "framed_infill", "external_envelope", None, "external_envelope", "framed_infill"]
_BLOCKS = ["siporex", "foam concrete", "fly-ash", "Hollow Blocks", "cement block", "wire cut", "brick", "AAC"]
_NAMED = ["AAC block", "CLC block", "Fly ash brick", "Concrete hollow block", "Concrete solid block", "Red clay brick", None, "AAC block"]


@query("seller_wordings", f"""select s_suppkey, {_sql_one_of('s_suppkey', _COUNTRY)} as country, {_sql_one_of('s_suppkey', _DUTY)} as duty, {_sql_one_of('s_suppkey', _NAMED)} as block,
  'v_' || substr(sha1(s_name || '|' || s_suppkey), 1, 16) as vendor_id, {_sql_one_of('s_suppkey', ["Cement", "TMT steel", "other kind"])} as category,
  array_to_string(list_filter([s_name, case when s_suppkey % 2 = 0 then '' else 'odd' end, s_suppkey::varchar, 'last'], lambda x: x <> '')[1:3], ' · ') as chips from supplier""")
def seller_wordings(spark, sf_dir):
    """Countries, wall duties, blocks and categories as they are named, vendor ids, and the first three chips of a card."""
    chips = labels.chips(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise(F.lit("odd")), F.col("s_suppkey"), F.lit("last"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        labels.country(_one_of("s_suppkey", _MADE)).alias("country"),
        labels.wall_duty(_one_of("s_suppkey", _WALLS)).alias("duty"),
        labels.block_named(_one_of("s_suppkey", _BLOCKS)).alias("block"),
        units.short_id("v_", F.col("s_name"), F.col("s_suppkey").cast("string")).alias("vendor_id"),
        labels.named(labels.CATEGORY_NAMES, _one_of("s_suppkey", ["cement", "tmt_steel", "other_kind"])).alias("category"),
        F.array_join(chips, " · ").alias("chips"),
    )


@query("ist_times", """select event_id, strftime(ts + interval 330 minute, '%-d %b %Y, %-I:%M ') || lower(strftime(ts + interval 330 minute, '%p')) as shown,
  case when h < 1 then 'just now' when h < 24 then floor(h)::bigint || ' h ago' when h < 720 then floor(h / 24)::bigint || ' d ago' else floor(h / 720)::bigint || ' mo ago' end as age, case when h < 24 then 'green' when h < 72 then 'amber' else 'red' end as dot
  from (select *, greatest(0, (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts)) / 3600000000.0::double) as h from events)""")
def ist_times(spark, sf_dir):
    """When a price was seen, in India's time, and how long ago that is said to be."""
    age = freshness.age_hours(F.col("ts"), F.lit("2024-01-31 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", freshness.format_ist(F.col("ts")).alias("shown"), freshness.humanise(age).alias("age"), freshness.dot(age).alias("dot"))
