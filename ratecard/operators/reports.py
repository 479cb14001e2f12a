"""Reports over runs, sources, titles and pictures, and the joins between states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import loosen
from .ranking import neighbours, placed

SHOCK = 0.03


def elementary_spans(rates: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """``rates`` as disjoint spans ``[_from, _until)`` of each key, with the columns of the
    rate in force there: of all that hold, the one that started last; of those, the
    one that ends first, then the greatest values. Open ends never end.

    Rates may nest: every start and every end cuts, and a long rate comes back
    when a short one inside it is over.
    """
    never = F.lit("9999-12-31").cast("date")
    rest = [c for c in rates.columns if c not in on]
    own = rates.withColumns({"_s": F.col(start).cast("date"), "_e": F.coalesce(F.date_add(F.col(end).cast("date"), 1), never)}).where("_s < _e")
    cuts = own.select(*on, F.explode(F.array("_s", "_e")).alias("_from")).distinct()
    spans = cuts.withColumn("_until", F.lead("_from").over(Window.partitionBy(*on).orderBy("_from"))).where("_until is not null")
    held = spans.alias("x").join(own.alias("y"), on).where("_s <= _from and _from < _e")
    latest = F.max_by(F.struct(*rest), F.struct(F.col("_s"), F.date_diff(never, F.col("_e")), *rest))
    return held.groupBy(*on, "_from", "_until").agg(latest.alias("_rate")).select(*on, "_from", "_until", "_rate.*")


def as_of_join(facts: DataFrame, rates: DataFrame, on: list[str], day: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Each fact with the latest rate in force on its day; null if there is none.

    Rates become disjoint spans first, so each fact meets at most one of them: an
    equi-join with a range condition and no ranking of the facts.
    """
    spans = elementary_spans(rates, on, start, end).withColumnsRenamed({c: f"r_{c}" for c in on})
    condition = [facts[c] == spans[f"r_{c}"] for c in on] + [(F.col(day) >= F.col("_from")) & (F.col(day) < F.col("_until"))]
    return facts.join(spans, condition, "left").drop("_from", "_until", *(f"r_{c}" for c in on))


def convert_price(rows: DataFrame, conversions: DataFrame) -> DataFrame:
    """A price per ``from_unit`` as one per ``to_unit``: identity, then a SKU's own
    factor, then a row of the table, then an inverse row; first row in its order.

    ``rows``: amount, from_unit, to_unit, category, sku_factor; ``conversions``:
    position, from_unit, to_unit, category ('*' for any), factor.
    """
    usable = conversions.where("factor > 0")
    any_category = lambda a, b: F.explode(F.array(F.col(a), F.lit("*"))).alias(b)
    keys = rows.select("from_unit", "to_unit", "category").distinct()
    probe = keys.select("from_unit", "to_unit", "category", any_category("category", "c"))
    def lookup(name: str, source: str, target: str) -> DataFrame:
        table = usable.select("position", F.col("from_unit").alias("f"), F.col("to_unit").alias("t"), F.col("category").alias("c"), "factor")
        met = probe.join(table, (probe[source] == table["f"]) & (probe[target] == table["t"]) & (probe["c"] == table["c"]))
        return met.groupBy("from_unit", "to_unit", "category").agg(F.min_by("factor", "position").alias(name))

    on = ["from_unit", "to_unit", "category"]
    out = rows.join(lookup("direct", "from_unit", "to_unit"), on, "left").join(lookup("inverse", "to_unit", "from_unit"), on, "left")
    half = lambda c: F.floor(c + 0.5).cast("bigint")
    a = F.col("amount")
    price = F.when(F.col("from_unit") == F.col("to_unit"), a).when(F.coalesce(F.col("sku_factor"), F.lit(0.0)) > 0, half(a / F.col("sku_factor"))).when(F.col("direct").isNotNull(), half(a / F.col("direct"))).when(F.col("inverse").isNotNull(), half(a * F.col("inverse")))
    via = F.when(F.col("from_unit") == F.col("to_unit"), "identity").when(F.coalesce(F.col("sku_factor"), F.lit(0.0)) > 0, "sku").when(F.col("direct").isNotNull(), "direct").when(F.col("inverse").isNotNull(), "inverse")
    return out.withColumn("converted", price).withColumn("via", via).drop("direct", "inverse")


def run_diff(before: DataFrame, now: DataFrame, on: list[str], amount: str, shock: float = SHOCK) -> DataFrame:
    """Changed, appeared and vanished rows between two runs; ``is_shock`` beyond 3 %."""
    a = before.select(*on, F.col(amount).alias("was"))
    b = now.select(*on, F.col(amount).alias("now"))
    both = a.join(b, on, "full")
    kind = F.when(F.col("was").isNull(), "appeared").when(F.col("now").isNull(), "vanished").when(F.col("was") != F.col("now"), "changed")
    change = F.abs(F.col("now") - F.col("was")) / F.col("was")
    return both.withColumn("kind", kind).where("kind is not null").withColumn("is_shock", F.coalesce(change > shock, F.lit(False)))


def not_in(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows that are not among ``seen``."""
    return rows.join(seen.select(*on).distinct(), on, "left_anti")


def latest_per_key(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key, by an aggregate with a map-side part: no window, no sort."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(at, *ties))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(rows.columns)


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """The next snapshot. Each column's policy: ``new`` (overwrite), ``prefer_new``
    or ``prefer_old`` (the other one where it is null), ``keep`` (the old one, or
    the new one of a new key)."""
    a = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in policy), F.lit(True).alias("_o"))
    b = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in policy), F.lit(True).alias("_n"))
    both = a.join(b, keys, "full")

    def pick(c: str, rule: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if rule == "prefer_new":
            return F.coalesce(n, o)
        if rule == "prefer_old":
            return F.coalesce(o, n)
        if rule == "new":
            return F.when(F.col("_n"), n).otherwise(o)
        if rule == "keep":
            return F.when(F.col("_o"), o).otherwise(n)
        raise ValueError(f"unknown policy {rule!r}")

    return both.select(*keys, *(pick(c, r).alias(c) for c, r in policy.items()))


def over_merged(rows: DataFrame, product: str, title: str, worst: int = 8) -> DataFrame:
    """Products under which several different titles were merged, worst first."""
    names = rows.select(product, loosen(F.col(title)).alias("t")).distinct()
    return names.groupBy(product).agg(F.count("*").alias("n_titles")).where("n_titles > 1").orderBy(F.desc("n_titles"), product).limit(worst)


def brand_tokens(rows: DataFrame, title: str, known: list[str], top: int = 40) -> DataFrame:
    """Frequent capitalised words that are no known brand, with an example each."""
    capitalised = F.filter(F.split(title, r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w.rlike("^[A-Z][a-z]{3,}$"))
    words = rows.select(F.explode(F.array_distinct(capitalised)).alias("token"), F.substring(title, 1, 60).alias("t"))
    fresh = words.where(~F.lower("token").isin([k.lower() for k in known]))
    return fresh.groupBy("token").agg(F.count("*").alias("n"), F.min("t").alias("example")).orderBy(F.desc("n"), "token").limit(top)


def field_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, total): values that are neither null nor blank, in one pass."""
    filled = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in columns))
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), "total") for c in columns)))
    return filled.select(one.alias("x")).select("x.*")


def json_keys(rows: DataFrame, column: str) -> DataFrame:
    """(key, n, n_values): keys of a JSON column, with a value, and distinct values."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return pairs.where("value is not null and value <> ''").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def price_tails(rows: DataFrame, low: int = 5, high: int = 4) -> DataFrame:
    """The lowest and highest offers of each category and region; windows with a limit, which Spark cuts early."""
    w = Window.partitionBy("category", "region")
    bottom = rows.withColumn("place", F.row_number().over(w.orderBy("landed_minor", "offer_key"))).where(F.col("place") <= low).withColumn("tail", F.lit("low"))
    upper = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("landed_minor"), "offer_key"))).where(F.col("place") <= high).withColumn("tail", F.lit("high"))
    return bottom.unionByName(upper).select("category", "region", "tail", "place", "offer_key", "landed_minor")


def freshness_histogram(rows: DataFrame, age: str = "age_hours", edges: tuple[int, ...] = (24, 72, 168)) -> DataFrame:
    """Rows under 24 h, 72 h, a week, and older, in one aggregate."""
    out, low = [], 0
    for high in edges:
        out.append(F.count_if((F.col(age) >= low) & (F.col(age) < high)).alias(f"under_{high}h"))
        low = high
    return rows.agg(*out, F.count_if(F.col(age) >= low).alias("older"), F.count("*").alias("total"))


def region_parity(rows: DataFrame, one: str, two: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Whether two regions' medians of a category are within a factor of two."""
    from ..functions.money import median_minor

    medians = rows.where(F.col("region").isin(one, two)).groupBy("category").agg(median_minor(F.when(F.col("region") == one, F.col("landed_minor"))).alias("one"), median_minor(F.when(F.col("region") == two, F.col("landed_minor"))).alias("two"))
    ratio = F.col("one") / F.col("two")
    return medians.withColumn("in_parity", F.when(F.col("two") > 0, ratio.between(low, high)))


def nearest_rank(rows: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(p, value) by nearest rank, ceil(p / 100 * n), from counts of distinct values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    upto = counts.select(F.col(value).alias("value"), "n", F.sum("n").over(Window.orderBy(value)).alias("upto"))
    total = counts.agg(F.sum("n").alias("total"))
    at = upto.join(F.broadcast(total)).select("value", "upto", (F.col("upto") - F.col("n")).alias("before"), "total", F.explode(F.array(*map(F.lit, percents))).alias("p"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") / 100 * F.col("total")))
    return at.where((F.col("before") < rank) & (rank <= F.col("upto"))).select("p", "value")


def substitutes(rows: DataFrame, n: int = 6) -> DataFrame:
    """For each product and region the nearest-priced other products of its category.

    Of nearest prices the best n are among the n before and n after in price
    order, so neighbours come from places in that order, not from a self-join.
    """
    group = ["category", "region"]
    ranked = placed(rows.select(*group, "product_id", "floor_minor"), group, [F.asc("floor_minor"), F.asc("product_id")])
    own = neighbours(ranked, group, "place", n, F.struct("product_id", "floor_minor"), "near")
    best = F.slice(F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x.floor_minor - F.col("floor_minor")).alias("gap"), x.product_id.alias("other")))), 1, n)
    return own.select(*group, "product_id", F.posexplode(best).alias("place", "x")).select(*group, "product_id", (F.col("place") + 1).alias("place"), F.col("x.other").alias("other"), F.col("x.gap").alias("gap"))
