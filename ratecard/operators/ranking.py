"""Scores, orders and representatives of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Weights in force at cold start, certification features and tiers, penalties.
WEIGHTS = {"f1": 0.31, "f2": 0.16, "f3": 0.16, "f4": 0.10, "f5": 0.10, "f6": 0.07, "f7": 0.06, "f8": 0.0, "f9": 0.04}
CERTIFICATION = {"CERTIFIED": (1.0, 4), "BRAND_LICENSED": (0.8, 3), "NOT_APPLICABLE": (0.7, 2), "NOT_DECLARED": (0.3, 1), "EXPIRED": (0.0, 0)}
PENALTIES = {"stale": 0.25, "out_of_stock": 0.60, "moq": 0.35}
LABELS = {"f1": "relevance", "f2": "attributes", "f3": "price", "f4": "availability", "f5": "rating", "f6": "certification", "f7": "lead time", "f8": "distance", "f9": "freshness"}
PRIOR_RATINGS, MEAN_RATING = 20, 3.9


def certification(state: Column, place: int) -> Column:
    """0: its feature, 1: its tier."""
    out = F.lit(None)
    for name, row in CERTIFICATION.items():
        out = F.when(state == name, F.lit(row[place])).otherwise(out)
    return out


def shrunk_rating(rating: Column, reviews: Column) -> Column:
    """The rating drawn to the mean as by 20 reviews of 3.9, over 5."""
    n = F.coalesce(reviews, F.lit(0))
    return (F.coalesce(rating, F.lit(MEAN_RATING)) * n + MEAN_RATING * PRIOR_RATINGS) / (n + PRIOR_RATINGS) / 5


def hard_filtered(regulated: Column, state: Column) -> Column:
    return F.coalesce(regulated & (state == "EXPIRED"), F.lit(False))


def banded(rows: DataFrame, group: list[str], band: Column, order: list[Column], number: str, places: str = "rank") -> DataFrame:
    """``rows`` with their rank (``places`` "row_number": place) in their group, and ``_total``, its size.

    ``band`` is an integer that never falls along the order. Places are counted
    within (group, band) and the sizes of earlier bands are added, so that a group
    of any size is sorted by as many tasks as it has bands.
    """
    # never null: a test for that, put below the exchange for the join's sake, would compute the band again.
    # The sizes read all columns, so that they come from the same exchange as the rows: what lies below it runs once
    rows = rows.withColumn("_band", F.coalesce(band.cast("bigint"), F.lit(-(1 << 62)))).repartition(*group, "_band")
    whole = F.max(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))).alias("_whole")
    sizes = rows.groupBy(*group, "_band").agg(F.count("*").alias("_n"), whole).where("_whole is not null").drop("_whole")
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "_band", before.alias("_before"), F.sum("_n").over(w).alias("_total"))
    within = {"rank": F.rank, "row_number": F.row_number}[places]().over(Window.partitionBy(*group, "_band").orderBy(*order))
    return rows.withColumn("_within", within).join(sizes, [*group, "_band"]).withColumn(number, F.col("_before") + F.col("_within")).drop("_band", "_within", "_before")


def placed(rows: DataFrame, group: list[str], order: list[Column], number: str = "place") -> DataFrame:
    """``rows`` with their place in their group, and ``_total``, its size, whatever the values are.

    Rows are dealt to ranges of (group, order), which a sample makes about equal, and
    written; a range then is the band that ``banded`` counts in. ``order`` is best
    total: only rows that are equal in it can make a range larger than others.
    """
    ranges = rows.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("_range", F.spark_partition_id())
    return banded(stored(ranges, "ranges"), group, F.col("_range"), order, number, "row_number").drop("_range")


#: Places of a block in which neighbours are looked up.
BLOCK = 4096


def neighbours(rows: DataFrame, group: list[str], place: str, n: int, what: Column, name: str) -> DataFrame:
    """``rows``, which have their ``place`` in their group, with ``what`` of the n rows before and after, nearest first.

    Places are cut into blocks, and the n rows at a border are in both blocks, so
    that a group of any size is many windows of ``BLOCK`` rows or so.
    """
    if n > BLOCK:
        raise ValueError("more neighbours than a block has rows")
    at = F.pmod(F.col(place) - 1, F.lit(BLOCK))
    block = F.expr(f"({place} - 1) div {BLOCK}")
    blocks = F.array_compact(F.array(block, F.when(at < n, block - 1), F.when(at >= BLOCK - n, block + 1)))
    dealt = rows.withColumns({"_own": block, "_what": what}).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*group, "_block").orderBy(place)
    near = F.array_compact(F.array(*(f("_what", k).over(w) for k in range(1, n + 1) for f in (F.lag, F.lead))))
    return dealt.withColumn(name, near).where("_own = _block").drop("_own", "_block", "_what")


def amount_band(amount: Column) -> Column:
    """A band for amounts in minor units: some ninety to each doubling."""
    return F.floor(F.log2(F.greatest(amount, F.lit(1)).cast("double")) * 90)


def percent_rank(rows: DataFrame, group: list[str], band: Column, order: list[Column], name: str) -> DataFrame:
    """SQL's percent_rank in groups of any size."""
    rows = banded(rows, group, band, order, "_rank")
    return rows.withColumn(name, F.when(F.col("_total") == 1, 0.0).otherwise((F.col("_rank") - 1) / (F.col("_total") - 1))).drop("_rank", "_total")


def score(rows: DataFrame, *group: str, requested: int = 1, default_relevance: float = 0.5, default_match: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with the nine features, ``score``, ``score_e9`` (the score in billionths) and ``why``. Coarser units are taken
    from ``score`` (``in_units``), not from ``score_e9``, so that a score is rounded once.

    ``group``: the set that prices are compared in. Wanted columns: landed_minor,
    stock_state, lead_days, age_hours, sla_hours, freshness, moq; optional ones:
    relevance, attr_match, rating, reviews, cert_state. ``keep``: the columns that are read
    afterwards, of all by default; no others are shuffled, so whoever reads all of them shuffles rows once.
    """
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)
    lead = F.coalesce(F.col("lead_days"), F.lit(3)).cast("double")
    none = F.lit(None).cast("double")
    penalties = F.when(F.col("freshness").isin("STALE", "EXPIRED"), PENALTIES["stale"]).otherwise(0.0) + F.when(F.col("stock_state") == "out_of_stock", PENALTIES["out_of_stock"]).otherwise(0.0) + F.when(F.coalesce(F.col("moq") > requested, F.lit(False)), PENALTIES["moq"]).otherwise(0.0)
    own = {
        "f1": F.greatest(F.lit(0.0), F.least(F.lit(1.0), has("relevance", default_relevance))),
        "f2": F.greatest(F.lit(0.0), F.least(F.lit(1.0), has("attr_match", default_match))),
        "f4": F.when(F.col("stock_state") == "out_of_stock", 0.0).when(lead > 7, 0.5).otherwise(1.0),
        "f5": shrunk_rating(F.col("rating") if "rating" in rows.columns else none, F.col("reviews") if "reviews" in rows.columns else none),
        "f6": certification(F.col("cert_state"), 0) if "cert_state" in rows.columns else F.lit(CERTIFICATION["NOT_DECLARED"][0]),
        "f7": F.exp(-lead / 7),
        "f8": F.lit(0.0),
        "f9": 1 - F.least(F.lit(1.0), F.col("age_hours") / F.col("sla_hours")),
        "_lost": penalties,
    }
    # what is the same for all rows is not shuffled with them
    read = {"f1": {"relevance"}, "f2": {"attr_match"}, "f5": {"rating", "reviews"}, "f6": {"cert_state"}, "f8": set()}
    alike = {k for k, columns in read.items() if not columns & set(rows.columns)}
    kept = list(dict.fromkeys([*group, "landed_minor", *(rows.columns if keep is None else keep)]))
    rows = rows.select(*(c for c in kept if c not in own), *(c.alias(k) for k, c in own.items() if k not in alike))
    rows = percent_rank(rows, list(group), amount_band(F.col("landed_minor")), [F.asc("landed_minor")], "_cheaper")
    rows = rows.withColumns({k: own[k] for k in alike} | {"f3": 1 - F.col("_cheaper")}).drop("_cheaper")
    total = sum((F.col(k) * w for k, w in WEIGHTS.items() if w), F.lit(0.0))
    # stable on ties: the order of the weights
    parts = F.array(*(F.struct((-F.round(F.col(k) * w, 9)).alias("v"), F.lit(i).alias("i"), F.lit(LABELS[k]).alias("label")) for i, (k, w) in enumerate(WEIGHTS.items()) if w))
    why = F.transform(F.slice(F.array_sort(parts), 1, 2), lambda p: p.label)
    return rows.withColumn("score", total - F.col("_lost")).drop("_lost").withColumns({"score_e9": in_units(F.col("score"), 1e9), "why": why})


def in_units(score: Column, unit: float) -> Column:
    """A score in whole units (1e6: millionths), halves up."""
    return F.floor(score * unit + 0.5).cast("bigint")


def published_order() -> list[Column]:
    """Score, price, age, certification tier, rating and key: a total order."""
    return [F.desc("score_e9"), F.asc("landed_minor"), F.desc("fetched_at"), F.desc("cert_tier"), F.desc("rating_e9"), F.asc("offer_key")]


#: The orders that a search can ask for, each ending in the published rank.
def sort_order(name: str, tie: str = "rank_pos") -> list[Column]:
    orders = {
        "recommended": [],
        "price_low": [F.expr("freshness = 'EXPIRED'").asc(), F.asc("landed_minor")],
        "fastest": [F.coalesce("lead_days", F.lit(9)).asc()],
        "freshest": [F.desc("fetched_at")],
        "best_value": [F.asc("value_e9")],
    }
    if name not in orders:
        raise ValueError(f"unknown sort {name!r}; known: {', '.join(orders)}")
    return orders[name] + [F.asc(tie)]


def column_order(column: str, descending: bool, *ties: str) -> list[Column]:
    """By a column in either direction; rows without a value last in both."""
    c = F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), *(F.asc(t) for t in ties)]


#: What price, rating and a certificate weigh in best value, and the rating of the unrated.
VALUE_WEIGHTS, UNRATED = (0.5, 0.3, 0.2), 3.5


def best_value(rows: DataFrame, *group: str) -> DataFrame:
    """value_e9, least first, in billionths: the price's place from 0 to 1, less for a rating of five and for a certificate."""
    ranked = banded(rows, list(group), amount_band(F.col("landed_minor")), [F.asc("landed_minor")], "_rank")
    price = (F.col("_rank") - 1) / F.greatest(F.col("_total") - 1, F.lit(1))
    rating = F.coalesce(F.col("rating"), F.lit(UNRATED)) if "rating" in rows.columns else F.lit(UNRATED)
    certified = F.coalesce(F.col("cert_state") == "CERTIFIED", F.lit(False)) if "cert_state" in rows.columns else F.lit(False)
    value = VALUE_WEIGHTS[0] * price - VALUE_WEIGHTS[1] * rating / 5 - VALUE_WEIGHTS[2] * certified.cast("double")
    return ranked.withColumn("value_e9", F.floor(value * 1e9 + 0.5).cast("bigint")).drop("_rank", "_total")


def by_product(ranked: DataFrame, *group: str, shown: tuple[str, ...] = ()) -> DataFrame:
    """One row for each product: its cheapest live offer, at the place of its first-ranked one.

    ``ranked`` has rank_pos. Quotable beats dead, then the cheaper, then the
    earlier. Both are aggregates, so that a product of very many offers is
    reduced before it is shuffled. ``shown``: further columns of the offer that is shown. Scores, if there are any, are given too.
    """
    scored = "score_e9" in ranked.columns
    own = dict.fromkeys(("offer_key", *(("score_e9",) if scored else ()), *shown))
    # one least row, not one for each column: what is shuffled holds the order once
    card = F.min(F.struct((~F.col("quotable")).alias("dead"), "landed_minor", "rank_pos", F.struct(*own).alias("own")))
    found = ranked.groupBy(*group, "product_id").agg(F.min("rank_pos").alias("position"), card.alias("card"), *((F.max("score_e9").alias("best_score_e9"),) if scored else ()), F.countDistinct("vendor_id").alias("n_sellers"), F.count("*").alias("n_offers"))
    best = [F.col("card.own.score_e9").alias("shown_score_e9"), F.col("best_score_e9")] if scored else []
    return found.select(*group, "product_id", "position", "card.own.offer_key", "card.landed_minor", *best, "n_sellers", "n_offers", *(F.col(f"card.own.{c}") for c in shown))


def vendor_rollup(rows: DataFrame, *group: str) -> DataFrame:
    """One row for each vendor: the cheapest offer, and how many others it lists."""
    order = F.struct((F.col("stock_state") == "out_of_stock").alias("o"), "landed_minor", "offer_key")
    return rows.groupBy(*group, "vendor_id").agg(F.min_by("offer_key", order).alias("offer_key"), F.min_by("landed_minor", order).alias("landed_minor"), (F.count("*") - 1).alias("also_listed"))


def vendor_listings(rows: DataFrame, n: int, *group: str) -> DataFrame:
    """One row for each vendor: its cheapest offer, its next ``n`` in ``also_listed``, and how many others there are.

    In-stock offers come first. The first n + 1 of a vendor are cut before the shuffle, so no list grows with the data.
    """
    order = [F.expr("stock_state = 'out_of_stock'").asc(), F.asc("landed_minor"), F.asc("offer_key")]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "vendor_id").orderBy(*order))).where(F.col("_n") <= n + 1)
    nested = F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", "offer_key", "landed_minor"))))
    shown = first.groupBy(*group, "vendor_id").agg(F.min_by(F.struct("offer_key", "landed_minor"), "_n").alias("_best"), nested.alias("_others"))
    counts = rows.groupBy(*group, "vendor_id").agg((F.count("*") - 1).alias("n_others"))
    listed = F.transform("_others", lambda x: F.struct(x.offer_key.alias("offer_key"), x.landed_minor.alias("landed_minor")))
    return shown.join(counts, [*group, "vendor_id"]).select(*group, "vendor_id", "_best.offer_key", "_best.landed_minor", listed.alias("also_listed"), "n_others")


def min_max(score_column: str, *group: str) -> Column:
    """A list's scores from 0 to 1; all 0 if they are alike."""
    w = Window.partitionBy(*group)
    low, high = F.min(score_column).over(w), F.max(score_column).over(w)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (F.col(score_column) - low) / span
