"""From raw listings to typed offers: attributes, canonical prices, identity, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import country
from ..functions.money import half_up
from ..functions.units import bar_kg_per_m, bore_mm, cement_bag_price, loosen, normalise_unit, number_in, short_id, squash
from .plausibility import implausible_reason, off_topic_reason

#: Parts of each category's identity beside category and brand; in brackets those that may not apply.
IDENTITY = {"cement": ("cement_type", "pack_kg", "[grade]"), "tmt_steel": ("diameter_mm", "grade"), "water_pipes": ("pipe_system", "bore_mm", "[pipe_class]", "length_m"), "bricks_blocks": ("block_type", "size_mm")}
#: Kilograms of a canonical unit, typical sizes, lengths and densities, and mills that smelt their own steel.
UNIT_KG = {"cement": 50.0, "tmt_steel": 1.0, "water_pipes": 0.42, "bricks_blocks": 3.1}
TYPICAL_SIZE = {"Red clay brick": "230×110×75", "AAC block": "600×200×100"}
TYPICAL_DENSITY = {"AAC block": 600.0, "Red clay brick": 1900.0}
TYPICAL_LENGTH_M = {"tmt_steel": 12.0, "GI": 6.0, "": 3.0}
PRIMARY_MILLS = "tata / jsw / sail / vizag / rinl / jindal panther / essar / arcelor"
#: How types are written, the first that applies.
CEMENT_TYPES = ((r"\bppc\b|pozzolana", "PPC"), (r"\bpsc\b|slag", "PSC"), (r"white", "White cement"), (r"\bsrc\b|sulphate", "Sulphate resisting"), (r"\bopc\b|ordinary portland", "OPC"))
PIPE_SYSTEMS = (("cpvc", "CPVC"), (r"\bswr\b|soil.{0,8}waste|drainage", "SWR"), ("hdpe", "HDPE"), (r"\bgi\b|galvan", "GI"), ("upvc|pvc", "UPVC / PVC"))
BLOCK_TYPES = (
    (r"\baac\b|autoclaved|aerated", "AAC block"),
    (r"\bclc\b|cellular", "CLC block"),
    (r"fly\s?ash", "Fly ash brick"),
    ("hollow", "Concrete hollow block"),
    (r"solid.*(?:block|concrete)|concrete.*solid|cement block", "Concrete solid block"),
    (r"red\s?(?:clay\s?)?brick|clay\s?brick|wire\s?cut|table\s?mould|\bbrick\b", "Red clay brick"),
    ("block", "Concrete solid block"),
)
#: For each pipe system, where its class is written, and how it is named.
PIPE_CLASSES = {"CPVC": (r"SDR\s*-?\s*(11|13\.5)", "SDR-"), "UPVC / PVC": (r"CLASS\s*-?\s*([1-5])", "Class "), "SWR": (r"TYPE\s*-?\s*([AB])", "Type "), "HDPE": (r"PE\s*-?\s*(63|80|100)", "PE ")}
GI_CLASSES = (("heavy|red", "Heavy"), ("medium|blue", "Medium"), ("light|yellow", "Light"))
#: What else sellers state, and under which names.
COMMERCIAL = {"color": ("Color", "Colour"), "material": ("Material", "Material Type"), "form": ("Form",), "shape": ("Shape",), "shelf_life": ("Shelf Life",), "standard_compliance": ("Standard Compliance", "IS Code", "Standards")}
NOT_APPLICABLE = "~na"


def spec(specs: Column, *keys: str) -> Column:
    """The first non-blank value of the listed keys: same name without case, else a name that holds it."""
    entries = F.map_entries(F.coalesce(specs, F.create_map().cast("map<string,string>")))
    good = F.filter(entries, lambda e: F.trim(F.coalesce(e['value'], F.lit(""))) != "")

    def named(test) -> Column:
        return F.get(F.filter(good, lambda e: test(F.lower(e["key"]))), F.lit(0))["value"]

    picks = []
    for key in keys:
        low = key.lower()
        picks += [named(lambda name: name == low), named(lambda name: name.contains(low))]
    return F.trim(F.coalesce(*picks))


def with_brand(rows: DataFrame, roster: DataFrame | list[str], most_words: int = 4) -> DataFrame:
    """``rows`` (title, brand, specs) with ``brand`` replaced by the roster's: the longest one
    in the title, else in the stated brand, else in the specs; null if there is none.

    A brand is found as a run of whole words; one of six letters or more also where
    the words of a run are written apart or together. Runs of words meet the roster
    in an equi-join, each distinct wording once, so the roster may be a table of any size.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame([(b,) for b in roster], "name string") if isinstance(roster, list) else roster.toDF("name")
    plain, solid = loosen(F.col("name")), squash(F.col("name"))
    keys = F.array_compact(F.array(F.struct(F.lit("w").alias("kind"), plain.alias("key")), F.when(F.length(solid) >= 6, F.struct(F.lit("s").alias("kind"), solid.alias("key")))))
    known = known.where(plain != "").select("name", F.explode(keys).alias("k")).select("name", "k.kind", "k.key").distinct()

    def runs(text: str, tier: int) -> Column:
        words = F.filter(F.split(loosen(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != "")
        places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
        some = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(words) - i + 1)), lambda n: F.slice(words, i, n))))
        both = lambda r: F.array(F.struct(F.lit("w").alias("kind"), F.array_join(r, " ").alias("key")), F.struct(F.lit("s").alias("kind"), F.array_join(r, "").alias("key")))
        return F.transform(F.flatten(F.transform(some, both)), lambda k: F.struct(F.lit(tier).alias("tier"), k.kind.alias("kind"), k.key.alias("key")))

    rows = rows.withColumns({"_t": F.coalesce("title", F.lit("")), "_b": F.coalesce("brand", F.lit("")), "_m": F.coalesce(spec(F.col("specs"), "brand", "make"), F.lit(""))})
    texts = rows.select("_t", "_b", "_m").distinct()
    probes = texts.select("_t", "_b", "_m", F.explode(F.array_distinct(F.concat(runs("_t", 0), runs("_b", 1), runs("_m", 2)))).alias("p")).select("_t", "_b", "_m", "p.*")
    best = probes.join(known, ["kind", "key"]).groupBy("_t", "_b", "_m").agg(F.min_by("name", F.struct("tier", -F.length("name"), "name")).alias("_found"))
    return rows.join(best, ["_t", "_b", "_m"], "left").withColumn("declared_brand", F.col("brand")).withColumn("brand", F.col("_found")).drop("_t", "_b", "_m", "_found")


def _first(text: Column, pairs) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in reversed(pairs):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(value)).otherwise(out)
    return out


def _matched(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + pattern, 1), F.lit(""))


def pipe_bore(size: Column) -> Column:
    """Millimetres that are no wall: not marked as one, and not under ten beside a size in inches; else the inches by the table."""
    bare = F.regexp_replace(size, r"(?i)(?:thick|thk|wall|micron|gauge)\w*\s*[:\-]?\s*\d+(?:\.\d+)?\s*mm|\d+(?:\.\d+)?\s*mm\s*(?:thick|thk|wall)", " ")
    inch = _matched(size, r'(\d+(?:\s*/\s*\d+|\.\d+)?(?:\s*[½¾¼])?|[½¾¼])\s*(?:inch|in\b|"|″)')
    stated = F.transform(F.regexp_extract_all(bare, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*mm"), 1), lambda x: x.cast("double"))
    return F.coalesce(F.get(F.filter(stated, lambda x: ~((x < 10) & inch.isNotNull())), F.lit(0)), bore_mm(inch).cast("double"))


def length_in_metres(stated: Column, title: Column) -> Column:
    """A length as stated, else as the title has it; feet are converted to two places."""
    metres = lambda n, feet: F.when(feet, F.round(n * 0.3048, 2)).otherwise(n)
    own = metres(number_in(stated), stated.rlike("(?i)f(ee)?t"))
    unit = r"(\d+(?:\.\d+)?)\s*(m|mtrs?|met(?:er|re)s?|feet|ft)\b(?!\s*m\b)"
    named = metres(_matched(title, unit).try_cast("double"), F.regexp_extract(title, "(?i)" + unit, 2).rlike("(?i)f(ee)?t"))
    return F.coalesce(F.nullif(own, F.lit(0.0)), named)


def attributes(rows: DataFrame, roster: DataFrame | list[str]) -> DataFrame:
    """Typed attributes of every category, null where they do not apply."""
    rows = with_brand(rows, roster)
    title, specs = F.coalesce(F.col("title"), F.lit("")), F.col("specs")
    of = lambda category, value: F.when(F.col("category") == category, value)
    either = lambda *keys: F.concat_ws(" ", title, spec(specs, *keys))
    every = F.concat_ws(" ", title, F.concat_ws(" ", F.map_values(F.coalesce(specs, F.create_map().cast("map<string,string>")))))
    within = lambda x, low, high: F.when(x.between(low, high), x)
    grade_c = _matched(either("grade"), r"\b(33|43|53)\b")
    grade_s = F.upper(_matched(F.regexp_replace(F.concat_ws(" ", spec(specs, "grade", "steel grade", "material grade"), title), r"\s", ""), r"fe-?(415|500d|500|550d|550|600)"))
    pack = _matched(either("packaging size", "pack size", "weight"), r"(\d+(?:\.\d+)?)\s*kg").try_cast("double")
    diameter = F.coalesce(number_in(spec(specs, "size", "diameter", "thickness", "bar size", "dia")), _matched(title, r"(\d+(?:\.\d+)?)\s*mm").try_cast("double"))
    bar_length = within(number_in(spec(specs, "length", "bar length")), 1, 18)
    rows = rows.withColumns(
        {
            "cement_type": of("cement", _first(either("type", "cement type"), CEMENT_TYPES)),
            "pack_kg": of("cement", F.coalesce(pack, F.lit(50.0))),
            "diameter_mm": of("tmt_steel", diameter),
            "pipe_system": of("water_pipes", _first(every, PIPE_SYSTEMS)),
            "bore_mm": of("water_pipes", pipe_bore(F.concat_ws(" ", spec(specs, "size", "nominal size", "diameter", "pipe size", "outer diameter"), title))),
            "block_type": of("bricks_blocks", _first(every, BLOCK_TYPES)),
            "density_kg_m3": of("bricks_blocks", number_in(spec(specs, "density", "dry density"))),
            "fly_ash_pct": of("bricks_blocks", number_in(spec(specs, "fly ash", "fly ash content", "fly ash percentage"))),
            "compressive_strength_nmm2": of("bricks_blocks", number_in(spec(specs, "compressive strength", "strength", "crushing strength"))),
            "supply_type": spec(specs, "supply type", "business type", "seller type"),
            "country_of_origin": country(spec(specs, "country of origin", "origin", "made in")),
        }
    )
    trade = spec(specs, "trade type")
    rows = rows.withColumn("trade_type", F.when(trade.rlike("(?i)non"), "Non-Trade").when(trade.isNotNull(), "Trade"))
    rows = rows.withColumns({name: F.when(F.length(v).between(2, 60), v) for name, keys in COMMERCIAL.items() if (v := spec(specs, *keys)) is not None})
    rows = rows.withColumn("declared_brand", F.when(F.length(F.trim("declared_brand")).between(1, 60), F.trim("declared_brand")))
    size = F.regexp_replace(_matched(F.lower(F.concat_ws(" ", spec(specs, "size", "dimension", "block size", "brick size"), title)), r"(\d{2,4}\s*[x×*]\s*\d{2,4}\s*[x×*]\s*\d{2,4})"), r"\s*[x×*]\s*", "×")
    typical = lambda table: F.coalesce(*(F.when(F.col("block_type") == k, F.lit(v)) for k, v in table.items()))
    classes = F.upper(F.concat_ws(" ", spec(specs, "class", "pressure class", "pressure rating", "sdr", "schedule", "grade"), title))
    kind = F.when(F.col("pipe_system") == "GI", _first(classes, GI_CLASSES))
    for system, (pattern, name) in PIPE_CLASSES.items():
        kind = F.when(F.col("pipe_system") == system, F.concat(F.lit(name), _matched(classes, pattern))).otherwise(kind)
    pipe_length = F.coalesce(within(length_in_metres(spec(specs, "length", "pipe length", "single piece length"), title), 0.5, 200), F.when(F.col("pipe_system") == "GI", TYPICAL_LENGTH_M["GI"]).otherwise(TYPICAL_LENGTH_M[""]))
    rows = rows.withColumns(
        {
            "grade": F.coalesce(of("cement", F.concat(grade_c, F.lit(" grade"))), of("tmt_steel", F.concat(F.lit("Fe "), grade_s))),
            "length_m": F.coalesce(of("tmt_steel", F.coalesce(bar_length, F.lit(TYPICAL_LENGTH_M["tmt_steel"]))), of("water_pipes", pipe_length)),
            "size_mm": of("bricks_blocks", F.coalesce(size, typical(TYPICAL_SIZE))),
            "density_kg_m3": F.coalesce("density_kg_m3", typical(TYPICAL_DENSITY)),
            "pipe_class": of("water_pipes", kind),
            "producer_type": of("tmt_steel", F.when(F.lower("brand").rlike("|".join(m.strip() for m in PRIMARY_MILLS.split("/"))), "Primary producer").when(F.col("brand").isNotNull(), "Secondary producer")),
        }
    )
    sides = F.transform(F.split("size_mm", "×"), lambda x: x.try_cast("double"))
    volume = F.when(F.size(sides) == 3, F.round(sides[0] * sides[1] * sides[2] / 1e9, 6))
    rod = of("tmt_steel", F.round(bar_kg_per_m(F.col("diameter_mm")) * F.col("length_m"), 3))
    return rows.withColumns({"unit_volume_m3": of("bricks_blocks", volume), "rod_weight_kg": rod})


def canonical_price(category: Column, amount: Column, unit: Column, factor: Column, pack_kg: Column, diameter_mm: Column, length_m: Column, volume_m3: Column | None = None, coil_m: Column | None = None) -> Column:
    """The price of one canonical unit of the category; null where the basis is not known.

    A coil needs a stated length of five metres or more, a cubic metre the volume of
    a piece; square feet of wall would need a thickness that nobody states.
    """
    coil_m = length_m if coil_m is None else coil_m
    kg_per_m = bar_kg_per_m(diameter_mm)
    tmt = F.when(unit == "kg", amount).when(unit == "tonne", half_up(amount / 1000)).when(unit == "quintal", half_up(amount / 100)).when(unit == "piece", half_up(amount / F.round(kg_per_m * length_m, 3))).when(unit == "running_metre", half_up(amount * factor / kg_per_m))
    pipe = F.when(unit == "running_metre", half_up(amount * factor)).when(unit == "piece", half_up(amount / length_m)).when((unit == "coil") & (coil_m >= 5), half_up(amount / coil_m))
    brick = F.when(unit == "piece", amount).when(unit == "per_1000", half_up(amount / 1000))
    if volume_m3 is not None:
        brick = brick.when(unit == "cum", half_up(amount * volume_m3))
    return F.when(category == "cement", cement_bag_price(amount, unit, pack_kg)).when(category == "tmt_steel", tmt).when(category == "water_pipes", pipe).when(category == "bricks_blocks", brick)


def item_code(category: Column, source_ref: Column) -> Column:
    """The identity of a product: category, brand and its parts. A part that does not
    apply is ``~na``; if a needed one is missing, the listing is a product of its own."""
    out = F.concat_ws("|", category, F.concat(F.lit("UNRESOLVED:"), source_ref))
    for name, parts in IDENTITY.items():
        values, missing = [], F.lit(False)
        for p in parts:
            value = F.lower(F.col(p.strip("[]")).cast("string"))
            if p == "[grade]":  # only ordinary cement has one
                value = F.when(F.col("cement_type") == "OPC", value).otherwise(F.lit(NOT_APPLICABLE))
            elif p.startswith("["):
                value = F.coalesce(value, F.lit(NOT_APPLICABLE))
            missing = missing | value.isNull()
            values.append(F.coalesce(value, F.lit(NOT_APPLICABLE)))
        whole = F.concat_ws("|", F.lit(name), F.coalesce(F.lower("brand"), F.lit("unbranded")), *values)
        out = F.when(category == name, F.when(missing, F.concat(whole, F.lit("|UNRESOLVED:"), source_ref)).otherwise(whole)).otherwise(out)
    return out


def build_title(*parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def certification_state(cert_text: Column, regulated: Column, brand: Column) -> Column:
    licensed = cert_text.rlike(r"(?i)CM/?L[-\s]?\d{6,10}|\bISI\b|IS\s?\d{3,5}")
    return F.when(cert_text.rlike("(?i)expired"), "EXPIRED").when(licensed, "CERTIFIED").when(regulated & brand.isNotNull(), "BRAND_LICENSED").when(~regulated, "NOT_APPLICABLE").otherwise("NOT_DECLARED")


def normalise(raw: DataFrame, roster: DataFrame | list[str]) -> DataFrame:
    """Every listing typed, with ``reject_reason``: the first stage that it fails, or null."""
    rows = attributes(raw, roster).withColumn("u", normalise_unit(F.col("price_unit")))
    every = F.concat_ws(" ", "title", F.concat_ws(" ", F.map_values(F.coalesce("specs", F.create_map().cast("map<string,string>")))))
    coil = _matched(every, r"(\d+(?:\.\d+)?)\s*(?:m|mtrs?|met(?:er|re)s?)\b").try_cast("double")
    rows = rows.withColumns({"unit": F.col("u.unit"), "canonical_minor": canonical_price(F.col("category"), F.col("price_paise"), F.col("u.unit"), F.col("u.factor"), F.col("pack_kg"), F.col("diameter_mm"), F.col("length_m"), F.col("unit_volume_m3"), coil)}).drop("u")
    none = F.lit(None).cast("boolean")
    off = off_topic_reason(F.col("category"), F.col("title"))
    implausible = implausible_reason(F.when(F.col("cement_type") == "White cement", "cement_white").otherwise(F.col("category")), F.col("title"), F.col("unit"), F.col("pack_kg"), F.col("bore_mm"), none, F.col("canonical_minor"))
    reason = F.coalesce(
        F.when(F.col("price_paise").isNull(), "no price"),
        off,
        F.when(F.col("unit").isNull(), "unknown unit"),
        F.when((F.col("category") == "bricks_blocks") & (F.col("unit") == "sqft"), "quoted by area of wall"),
        F.when(F.col("canonical_minor").isNull(), "no canonical basis"),
        implausible,
    )
    rows = rows.withColumn("reject_reason", reason).withColumn("item_code", item_code(F.col("category"), F.col("source_ref")))
    kg = F.lit(None).cast("double")
    for name, weight in UNIT_KG.items():
        kg = F.when(F.col("category") == name, F.lit(weight)).otherwise(kg)
    kg = F.when(F.col("category") == "bricks_blocks", F.coalesce(F.round(F.col("unit_volume_m3") * F.col("density_kg_m3"), 2), kg)).otherwise(kg)
    return rows.withColumns(
        {
            "product_id": short_id("p_", F.col("item_code")),
            "offer_id": short_id("o_", F.col("source_id"), F.col("source_ref")),
            "vendor_id": short_id("v_", F.lower(F.col("platform")), F.lower(F.col("vendor_name")), F.lower(F.coalesce("vendor_locality", F.lit("")))),
            "unit_kg": kg,
            "cert_state": certification_state(F.col("cert_text"), F.col("category").isin("cement", "tmt_steel"), F.col("brand")),
        }
    )


def ladder(quoted: Column, derived: Column, typical: Column) -> Column:
    """STRUCT<value, confidence>: the first rung that has a value."""
    rung = lambda value, name: F.when(value.isNotNull(), F.struct(value.cast("string").alias("value"), F.lit(name).alias("confidence")))
    return F.coalesce(rung(quoted, "quoted"), rung(derived, "derived"), rung(typical, "typical"), F.struct(F.lit(None).cast("string").alias("value"), F.lit("unknown").alias("confidence")))


def spec_values(offers: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(offer_id, field, value, confidence): provenance in long form; ``fields`` are ladders."""
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.value.alias("value"), c.confidence.alias("confidence")) for n, c in fields.items())))
    return offers.select("offer_id", one.alias("x")).select("offer_id", "x.*")


def best_spec(values: DataFrame, key: str = "offer_id") -> DataFrame:
    """The most trusted value of each field."""
    order = F.array_position(F.array(*map(F.lit, ("quoted", "derived", "typical", "unknown"))), F.col("confidence"))
    return values.groupBy(key, "field").agg(F.min_by(F.struct("value", "confidence"), F.struct(order.alias("o"), "value")).alias("x")).select(key, "field", "x.*")


def geocode(vendors: DataFrame, places: DataFrame) -> DataFrame:
    """Each vendor's place in its region: the same cleaned name, else one that holds
    the other (five letters or more), the first in the table's order.

    Names are compared once each, not once for each vendor.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", ""))
    v = vendors.withColumn("place_name", clean(F.col("locality")))
    names = v.select("region_id", "place_name").distinct().where("place_name <> ''")
    p = places.select("region_id", clean(F.col("name")).alias("n"), "position", "lat", "lon")
    near = (F.col("place_name") == F.col("n")) | ((F.length("place_name") >= 5) & (F.length("n") >= 5) & (F.col("place_name").contains(F.col("n")) | F.col("n").contains(F.col("place_name"))))
    best = names.join(p, "region_id").where(near).groupBy("region_id", "place_name").agg(F.min_by(F.struct("lat", "lon"), F.struct((F.col("place_name") != F.col("n")).alias("inexact"), "position")).alias("g"))
    return v.join(best, ["region_id", "place_name"], "left").select(*vendors.columns, "g.lat", "g.lon")


def run_accounting(rows: DataFrame) -> DataFrame:
    """(outcome, n) of a run; the sum is the number attempted."""
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Counts of stored offers whose price, unit or identity is not what the raw rows give."""
    both = stored.alias("s").join(derived.alias("d"), "offer_id")
    differs = lambda c: F.count_if(~F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}"))).alias(f"{c}_drift")
    return both.agg(F.count("*").alias("n"), differs("canonical_minor"), differs("unit"), differs("item_code"))


def first_rank(rows: DataFrame, group: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def changed_amounts(stored: DataFrame, derived: DataFrame, key: str = "offer_id", amount: str = "canonical_minor") -> DataFrame:
    """Offers whose amount a new derivation changes, the greatest change first, as |ln ratio| in millionths."""
    both = stored.select(key, F.col(amount).alias("was")).join(derived.select(key, F.col(amount).alias("now")), key).where("was > 0 and now > 0 and was <> now")
    return both.withColumn("change_e6", F.floor(F.abs(F.log(F.col("now") / F.col("was"))) * 1e6 + 0.5).cast("bigint")).orderBy(F.desc("change_e6"), key)


def refusals(rows: DataFrame) -> DataFrame:
    """What was refused and why, and which units were converted, in one table of counts."""
    why = rows.where("reject_reason is not null").groupBy(F.lit("refused").alias("kind"), F.col("reject_reason").alias("what"))
    units = rows.where("reject_reason is null").groupBy(F.lit("converted").alias("kind"), F.concat_ws(" -> ", "price_unit", "unit").alias("what"))
    return why.agg(F.count("*").alias("n")).unionByName(units.agg(F.count("*").alias("n")))


def load(raw: DataFrame, roster: DataFrame | list[str], places: DataFrame, rates: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """A load of raw listings: ``offers`` (accepted, with place and tax rate; the columns that
    ``known`` offers had stay where the new ones are null), ``rejects``, ``accounts``, ``specs``, and
    ``rows``, all listings as normalised: kept, since all others read them, until the caller unpersists them."""
    from .reports import as_of_join, keyed_upsert

    rows = normalise(raw, roster).persist()
    good = rows.where("reject_reason is null").withColumn("locality", F.col("vendor_locality"))
    placed = geocode(good, places)
    taxed = as_of_join(placed.withColumn("_day", F.to_date("fetched_at")), rates, ["category"], "_day").drop("_day", "effective_from", "effective_to")
    columns = ["product_id", "vendor_id", "item_code", "category", "brand", "canonical_minor", "unit", "rate", "lat", "lon", "cert_state", "fetched_at", "region_id"]
    offers = taxed.select("offer_id", *columns)
    if known is not None:
        offers = keyed_upsert(known, offers, ["offer_id"], {c: "new" if c in ("canonical_minor", "fetched_at") else "prefer_new" for c in columns})
    none = F.lit(None).cast("string")
    specs = spec_values(good, {c: ladder(F.col(c), none, none) for c in ("cement_type", "grade", "pipe_system", "block_type", "size_mm", "brand")})
    return {"offers": offers, "rejects": rows.where("reject_reason is not null"), "accounts": run_accounting(rows), "specs": specs, "rows": rows}
