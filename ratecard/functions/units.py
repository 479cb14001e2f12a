"""Units, bores, bar masses, and how a seller's wording becomes one of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import half_up

#: The unit that each category is compared in, and tables of standards.
CANONICAL_UNIT = {"cement": "bag", "tmt_steel": "kg", "water_pipes": "running_metre", "bricks_blocks": "piece"}
BORE_MM = {"1/2": 15, "3/4": 20, "1": 25, "1.25": 32, "1.5": 40, "1.75": 50, "2": 63, "2.5": 75, "3": 90, "4": 110, "6": 160, "8": 200}
TMT_KG_PER_M = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 16: 1.578, 20: 2.466, 25: 3.854, 28: 4.834, 32: 6.313, 36: 7.99, 40: 9.864}
FEET_IN_A_METRE = 3.28084
BAG_KG = 50
#: Wording of a quoted unit -> (unit, canonical units in it), first match wins.
UNIT_WORDS = (
    (r"^bag(\s|$|s)|bag of", "bag", 1.0),
    (r"^(piece|pieces|pcs?|nos?|number|unit|each|brick|bricks)$", "piece", 1.0),
    (r"^(kg|kilogram|kgs)$", "kg", 1.0),
    (r"^(ton|tonne|mt|metric ton)$", "tonne", 1.0),
    (r"^quintal$", "quintal", 1.0),
    (r"^(meter|metre|mtr|m|running meter|running metre|rmt)$", "running_metre", 1.0),
    (r"^(feet|foot|ft)$", "running_metre", FEET_IN_A_METRE),
    (r"^(cubic meter|cubic metre|cbm|cum|m3)$", "cum", 1.0),
    (r"^(cubic feet|cft)$", "cft", 1.0),
    (r"^(square feet|sq ?ft|sqft)$", "sqft", 1.0),
    (r"1000|thousand", "per_1000", 1.0),
    (r"^(roll|coil)$", "coil", 1.0),
    (r"^(box|packet|set|carton)$", "box", 1.0),
)


def normalise_unit(quoted: Column) -> Column:
    """STRUCT<unit, factor>, or null for wording that is no unit."""
    bare = F.regexp_replace(F.trim(quoted), r"(?i)^(/|per)\s*", "")
    out = F.lit(None).cast("struct<unit:string,factor:double>")
    for pattern, unit, factor in reversed(UNIT_WORDS):
        out = F.when(bare.rlike("(?i)" + pattern), F.struct(F.lit(unit).alias("unit"), F.lit(factor).alias("factor"))).otherwise(out)
    return F.when(F.coalesce(quoted, F.lit("")) != "", out)


def _lookup(table: dict, key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key).cast(kind)


def bore_mm(inches: Column) -> Column:
    """Nominal bore of a size in inches: from the table of standards, not by 25.4."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(inches), r'["″]|inch(es)?|\bin\b', ""), r"\s+", " "))
    for sign, fraction in (("½", "1/2"), ("¼", "1/4"), ("¾", "3/4")):
        text = F.trim(F.regexp_replace(text, rf"\s*{sign}", f" {fraction}"))
    key = text
    for fraction, part in (("1/4", ".25"), ("1/2", ".5"), ("3/4", ".75")):
        key = F.regexp_replace(key, rf"^(\d+) {fraction}$", f"$1{part}")
    key = F.when(key.isin("0.5", ".5"), "1/2").when(key.isin("0.75", ".75"), "3/4").otherwise(F.regexp_replace(key, r"\.0+$", ""))
    return _lookup(BORE_MM, key, "int")


def inches_of(bore: Column) -> Column:
    return _lookup({v: k for k, v in BORE_MM.items()}, bore.cast("int"), "string")


def bar_kg_per_m(diameter_mm: Column) -> Column:
    """Nominal mass of the standard diameter nearest within 0.6 mm; null if none is."""
    near = F.array_sort(F.filter(F.array(*map(F.lit, TMT_KG_PER_M)), lambda d: F.abs(d - diameter_mm) <= 0.6))
    return _lookup(TMT_KG_PER_M, F.get(near, F.lit(0)), "double")


def rod_kg(diameter_mm: Column, length_m: Column) -> Column:
    return bar_kg_per_m(diameter_mm) * length_m


def cement_bag_price(amount: Column, unit: Column, pack_kg: Column) -> Column:
    """A price in any unit of cement as a price for a bag of 50 kg; null if it cannot be."""
    pack = F.coalesce(pack_kg, F.lit(BAG_KG))
    return F.when(unit == "kg", half_up(amount * BAG_KG)).when(unit == "tonne", half_up(amount / 20)).when(unit == "quintal", half_up(amount / 2)).when(unit.isin("bag", "piece"), half_up(amount * BAG_KG / pack))


def number_in(text: Column) -> Column:
    """The first signed decimal, commas aside."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(\.\d+)?", 0).try_cast("double")


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def loosen(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normal_query(text: Column) -> Column:
    """Lower case, plain quotes, x for ×, single spaces, and a space between fused numbers and units."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[“”″]", '"'), "[‘’′]", "'")
    out = F.regexp_replace(F.regexp_replace(out, "×", "x"), r"\s+", " ")
    return F.regexp_replace(out, r"(\d)(mm|kg|cm|inch|ft|grade)\b", "$1 $2")


def entities_decoded(text: Column) -> Column:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))
