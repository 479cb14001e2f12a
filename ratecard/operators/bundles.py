"""Bundles and checks over the surface: source accounts, coverage, pictures, details, rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import median_minor
from . import facets

#: Pictures on a card, and the shares that are reported.
CARD_PICTURES = 5


def blocked_sources(log: DataFrame, n: int = 12) -> DataFrame:
    """(source_id, outcome, missed): sources that did not answer, by what they are thought to have had."""
    bad = log.where("outcome <> 'ok'").groupBy("source_id", "outcome").agg(F.sum(F.coalesce("missed", F.lit(0))).cast("bigint").alias("missed"))
    return bad.orderBy(F.desc("missed"), "source_id", "outcome").limit(n)


def source_failures(log: DataFrame) -> DataFrame:
    """Failed attempts of each source and outcome, with the last note in order."""
    return log.where("outcome <> 'ok'").groupBy("source_id", "outcome").agg(F.min("source_class").alias("source_class"), F.count("*").alias("n"), F.sum(F.coalesce("missed", F.lit(0))).cast("bigint").alias("missed"), F.max("note").alias("note"))


def attempt_outcome(status: Column, size: Column, rows: Column) -> Column:
    """What an attempt came to: refused, empty, not understood, or fine."""
    return F.when(status == 429, "rate_limited").when(status.isin(401, 403) | (status >= 500), "blocked").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(rows == 0, "parse_fail").otherwise("ok")


def run_ledger(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Attempts of a run by outcome, with whether they add up to all that was attempted."""
    counts = outcomes.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("attempted", F.sum("n").over(Window.partitionBy(*keys)))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("product_id").alias("products"), F.count("*").alias("offers"), F.countDistinct("vendor_id").alias("sellers"))


def surface_counts(summary: DataFrame) -> DataFrame:
    """Products, offers and the range of best prices of each category and region, from the price summary."""
    return summary.groupBy("category", "region_id").agg(F.count("*").alias("products"), F.sum("n_offers").cast("bigint").alias("offers"), F.min("floor_minor").alias("low_minor"), F.max("floor_minor").alias("high_minor"))


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, share) of the rows shown that have a value, to six places."""
    shares = rows.agg(*(F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(c) for c in columns))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns))).alias("x")).select("x.*")


def brand_resolution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count_if(F.col("brand").isNotNull()).alias("with_brand"), F.count("*").alias("total"), F.countDistinct("brand").alias("brands"))


def picture_buckets(counts: DataFrame, n: str = "n") -> DataFrame:
    """Of items with ``n`` pictures each: per ten thousand those with five or more, several, one and none."""
    capped = F.least(F.lit(CARD_PICTURES), F.coalesce(F.col(n), F.lit(0)))
    share = lambda test: F.floor(F.avg(test.cast("double")) * 10_000 + 0.5).cast("bigint")
    return counts.agg(F.count("*").alias("items"), share(capped >= CARD_PICTURES).alias("five_bp"), share(capped >= 2).alias("several_bp"), share(capped == 1).alias("one_bp"), share(capped == 0).alias("none_bp"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def freshness_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "region").agg(F.count("*").alias("n_offers"), F.count_if("quotable").alias("n_quotable"), F.count_if(F.col("freshness") == "FRESH").alias("n_fresh"), F.min("fetched_at").alias("oldest"))


def surface_change(before: DataFrame, now: DataFrame, amount: str = "landed_minor") -> DataFrame:
    """Number, least, median and most of each category before and after a rebuild."""
    one = lambda rows, p: rows.groupBy("category").agg(F.count("*").alias(f"{p}_n"), F.min(amount).alias(f"{p}_low"), median_minor(F.col(amount)).alias(f"{p}_median"), F.max(amount).alias(f"{p}_high"))
    return one(before, "before").join(one(now, "after"), "category", "full")


def previous_runs(runs: DataFrame, finished: str, run: str) -> DataFrame:
    """(run, previous): the run that finished last before each; runs are few, one row each."""
    return runs.select(F.col(run).alias("run"), F.lag(run).over(Window.orderBy(finished, run)).alias("previous"))


def contradicts(url: Column, brand: Column, kind: Column, heads: list[str], kinds: tuple[str, ...] = ("opc", "ppc", "psc"), least: int = 4) -> Column:
    """Whether a picture's address names another brand, or another type of the same goods, and not its own.

    Brand names under four letters stand in unrelated words and are no evidence.
    """
    low, own = F.lower(url), F.lower(F.regexp_extract(F.trim(brand), r"^\S+", 0))
    others = F.array(*(F.lit(h) for h in sorted({h.lower() for h in heads if len(h) >= least})))
    wrong_brand = (F.length(own) >= least) & ~low.contains(own) & F.exists(others, lambda h: (h != own) & low.contains(h))
    named = F.array_compact(F.array(*(F.when(low.rlike(f"[-_/]{k}[-_/.]"), F.lit(k)) for k in kinds)))
    wrong_kind = F.lower(kind).isin(*kinds) & (F.size(named) > 0) & ~F.array_contains(named, F.lower(kind))
    return F.coalesce(wrong_brand, F.lit(False)) | F.coalesce(wrong_kind, F.lit(False))


def pair_contradictions(offers: DataFrame, pictures: DataFrame, heads: list[str]) -> DataFrame:
    """(brand, n, wrong): pairs of an offer (product_id, brand) and a picture (product_id, url) of its product, and those that contradict.

    Both sides are counted by product first: pairs are products of counts, and an address is judged once for a product, not once for each offer.
    """
    own = offers.groupBy("product_id", "brand").agg(F.count("*").alias("_offers"))
    shown = pictures.groupBy("product_id", "url").agg(F.count("*").alias("_shown"))
    pairs = F.col("_offers") * F.col("_shown")
    wrong = contradicts(F.col("url"), F.col("brand"), F.lit(None).cast("string"), heads)
    return own.join(shown, "product_id").groupBy("brand").agg(F.sum(pairs).cast("bigint").alias("n"), F.sum(F.when(wrong, pairs).otherwise(0)).cast("bigint").alias("wrong"))


def card_pictures(offers: DataFrame, pictures: DataFrame, n: int = CARD_PICTURES) -> DataFrame:
    """(offer_key, pictures): an offer's own pictures first, then its product's, by rank and width; no address twice.

    Of a product no more than 2 n pictures are looked at for its offers: n of an
    offer's own and n of others fill any card. Both lists come from ranked windows
    that Spark cuts early, so a product of very many pictures is never gathered.
    """
    order = [F.asc("rank"), F.desc("width"), F.asc("url")]
    one = pictures.groupBy("product_id", "url").agg(F.min("rank").alias("rank"), F.max("width").alias("width"))
    pool = one.withColumn("place", F.row_number().over(Window.partitionBy("product_id").orderBy(*order))).where(F.col("place") <= 2 * n)
    pool = pool.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x.url).alias("pool"))
    # all steps by offer follow one exchange
    mine = pictures.repartition("offer_key").groupBy("offer_key", "url").agg(F.min("rank").alias("rank"), F.max("width").alias("width"))
    mine = mine.withColumn("place", F.row_number().over(Window.partitionBy("offer_key").orderBy(*order))).where(F.col("place") <= n)
    mine = mine.groupBy("offer_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x.url).alias("mine"))
    none = F.array().cast("array<string>")
    both = offers.select("offer_key", "product_id").join(mine, "offer_key", "left").join(pool, "product_id", "left")
    return both.select("offer_key", F.slice(F.array_distinct(F.concat(F.coalesce("mine", none), F.coalesce("pool", none))), 1, n).alias("pictures"))


def index_blob(products: DataFrame, offers: DataFrame, forms: dict[str, list[str]]) -> DataFrame:
    """(product_id, blob): all that a product is found by: title, brand, category,
    attributes, the category's words in all spellings, and the names of its sellers.

    Products without live offers stay. Sellers are made distinct before they are listed.
    """
    names = offers.select("product_id", "vendor_name").distinct().groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list("vendor_name")), " ").alias("sellers"))
    words = F.lit("")
    for category, own in forms.items():
        words = F.when(F.col("category") == category, F.lit(" ".join(own))).otherwise(words)
    return products.join(names, "product_id", "left").select("product_id", F.lower(F.concat_ws(" ", "title", "brand", "category", F.concat(F.lit("size "), F.col("size").cast("string")), words, "sellers")).alias("blob"))


def reconcile_facets(rows: DataFrame, defs: dict[str, tuple[Column, list[str]]], examples: int = 3) -> DataFrame:
    """(facet, value, n, data_backed, reason, examples): offers under every authored label.

    A label that no offer has says why: ``uncollected`` if the facet has no values at
    all, else ``unnormalised``, with the first values that fall under no label. One
    aggregate counts all labels; values of no label are made distinct before they are ranked.
    """
    held = rows.select(*(facets.facet_value(column).alias(f"_facet{i}") for i, (column, _) in enumerate(defs.values())))
    counts, names = [], []
    for i, (name, (_, labels)) in enumerate(defs.items()):
        for j, label in enumerate(labels):
            names.append((i, name, label))
            counts.append(F.count_if(facets.matches(F.col(f"_facet{i}"), label)).alias(f"n{i}_{j}"))
        counts.append(F.count_if(F.col(f"_facet{i}.text").isNotNull()).alias(f"any{i}"))
    counted = held.agg(*counts)
    place, cells = {}, []
    for i, name, label in names:
        j = place[i] = place.get(i, -1) + 1
        cells.append(F.struct(F.lit(name).alias("facet"), F.lit(label).alias("value"), F.col(f"n{i}_{j}").alias("n"), F.col(f"any{i}").alias("any")))
    out = counted.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    loose = None
    for i, (name, (_, labels)) in enumerate(defs.items()):
        under = F.lit(False)
        for label in labels:
            under = under | facets.matches(F.col(f"_facet{i}"), label)
        part = held.where(F.col(f"_facet{i}.text").isNotNull() & ~under).select(F.lit(name).alias("facet"), F.col(f"_facet{i}.text").alias("text")).distinct()
        loose = part if loose is None else loose.unionByName(part)
    first = loose.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy("text"))).where(F.col("place") <= examples)
    first = first.groupBy("facet").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    missing = F.col("n") == 0
    out = out.join(first, "facet", "left")
    return out.select("facet", "value", "n", (~missing).alias("data_backed"), F.when(missing, F.when(F.col("any") == 0, "uncollected").otherwise("unnormalised")).alias("reason"), F.when(missing, F.coalesce("examples", F.array().cast("array<string>"))).alias("examples"))


def anchors(rows: DataFrame, rates: DataFrame, home: str) -> DataFrame:
    """``rows`` (state, category) with their government rate: the state's own, else that of ``home``."""
    own = rates.select("state", "category", F.col("rate_minor").alias("own"))
    other = rates.where(F.col("state") == home).select("category", F.col("rate_minor").alias("other"))
    both = rows.join(own, ["state", "category"], "left").join(other, "category", "left")
    return both.select("state", "category", F.coalesce("own", "other").alias("rate_minor"), F.when(F.col("own").isNotNull(), F.col("state")).when(F.col("other").isNotNull(), F.lit(home)).alias("anchor"))


def tax_refresh(offers: DataFrame, asked: DataFrame) -> DataFrame:
    """How many offers of each category carry another rate than the one in force (``asked``: offer_key, rate)."""
    both = offers.select("offer_key", "category", "rate_bp").join(asked.select("offer_key", F.col("rate").alias("now")), "offer_key")
    return both.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("now").isNotNull() & (F.col("now") != F.col("rate_bp"))).alias("changed"), F.count_if(F.col("now").isNull()).alias("refused"))


def unseen_offers(offers: DataFrame, seen: DataFrame, key: str = "offer_key") -> DataFrame:
    """Offers that the last run did not see (an extension: nothing else marks them)."""
    return offers.join(seen.select(key).distinct(), key, "left_anti")


def vendor_table(rows: DataFrame, platform: str | None = None, in_stock: bool = False, certified: bool = False) -> DataFrame:
    """The filters over a product's sellers."""
    if platform is not None:
        rows = rows.where(F.col("platform") == platform)
    if in_stock:
        rows = rows.where("stock_state <> 'out_of_stock'")
    if certified:
        rows = rows.where("cert_state in ('CERTIFIED', 'BRAND_LICENSED')")
    return rows


def vendor_order(by: str) -> list[Column]:
    """Orders of the sellers' table: sellers without a value come last."""
    orders = {"moq": F.coalesce("moq", F.lit(2_147_483_647)).asc(), "eta": F.coalesce("lead_days", F.lit(99)).asc(), "rating": F.coalesce("rating", F.lit(-1.0)).desc()}
    if by not in orders:
        raise ValueError(f"unknown order {by!r}; known: {', '.join(orders)}")
    return [orders[by], F.asc("landed_minor"), F.asc("offer_key")]


def product_detail(offers: DataFrame, history: DataFrame, product: str = "product_id") -> DataFrame:
    """One row for each product: its offers, sellers, best offer, blocked offers, and how many observations its history has."""
    best = F.struct((F.col("stock_state") == "out_of_stock").alias("o"), "landed_minor", "offer_key")
    own = offers.groupBy(product).agg(
        F.count("*").alias("n_offers"),
        F.countDistinct("vendor_id").alias("n_sellers"),
        F.min_by("offer_key", best).alias("best_offer"),
        F.min_by("landed_minor", best).alias("best_minor"),
        F.count_if(~F.col("quotable")).alias("n_expired"),
    )
    seen = history.groupBy(product).agg(F.count("*").alias("n_observed"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    return own.join(seen, product, "left")


def product_page(detail: DataFrame, specs: DataFrame, substitutes: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each product and region of ``detail`` (product_id, region, category, ...): with its ``specs`` (product_id,
    field, value), its ``substitutes`` (product_id, region, place, other, gap) and the public rate of ``anchors`` (category,
    region, rate_minor; a null region is any). Lists hold a product's fields and a handful of substitutes: both are bounded."""
    fields = specs.where("value is not null").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("specs"))
    others = substitutes.groupBy("product_id", "region").agg(F.sort_array(F.collect_list(F.struct("place", "other", "gap"))).alias("substitutes"))
    own = anchors.where("region is not null").select("category", "region", F.col("rate_minor").alias("_own"))
    anywhere = anchors.where("region is null").select("category", F.col("rate_minor").alias("_any"))
    page = detail.join(fields, "product_id", "left").join(others, ["product_id", "region"], "left").join(own, ["category", "region"], "left").join(anywhere, "category", "left")
    return page.withColumn("anchor_minor", F.coalesce("_own", "_any")).drop("_own", "_any")


def measures(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Wide aggregates as (keys, measure, value) rows, so that bundles of several can be one table."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in columns)))
    return rows.select(*keys, one.alias("x")).select(*keys, "x.*")


def scope_of(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products, live offers and sellers of every category; categories without offers stay, at zero."""
    both = products.select("product_id", "category").join(offers.select("product_id", "offer_key", "vendor_id"), "product_id", "left")
    return both.groupBy("category").agg(F.countDistinct("product_id").alias("products"), F.count("offer_key").alias("offers"), F.countDistinct("vendor_id").alias("sellers"))


def priced_lines(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Lines of an estimate (estimate_id, category, quantity) at the cheapest live offer of their category and region."""
    best = offers.where("quotable and stock_state = 'in_stock'").groupBy("category", "region").agg(F.min(F.struct("landed_minor", "offer_key")).alias("b"))
    best = best.select("category", "region", F.col("b.landed_minor").alias("unit_minor"), F.col("b.offer_key").alias("offer_key"))
    return lines.join(best, ["category", "region"], "left").withColumn("line_minor", F.col("unit_minor") * F.col("quantity"))


def priced_estimates(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Each estimate's subtotal over the lines that could be priced, and how many those are."""
    return priced_lines(lines, offers).groupBy("estimate_id", "region").agg(F.coalesce(F.sum("line_minor"), F.lit(0)).cast("bigint").alias("subtotal_minor"), F.count("line_minor").alias("priced"), F.count("*").alias("n_lines"))


def price_position(rows: DataFrame, *group: str) -> DataFrame:
    """(offer_key, place, of): an offer's place by price among those of its product; ties by key."""
    w = Window.partitionBy(*group)
    return rows.select("offer_key", F.row_number().over(w.orderBy("landed_minor", "offer_key")).cast("bigint").alias("place"), F.count("*").over(w).alias("of"))


def identity_drift(stored: DataFrame, derived: DataFrame, key: str, amount: str, ratio: float = 0.0) -> DataFrame:
    """Stored amounts that a new derivation changes, by the size of the change as |ln ratio| in millionths."""
    both = stored.select(key, F.col(amount).alias("was")).join(derived.select(key, F.col(amount).alias("now")), key).where("was > 0 and now > 0 and was <> now")
    change = F.floor(F.abs(F.log(F.col("now") / F.col("was"))) * 1e6 + 0.5).cast("bigint")
    return both.withColumn("change_e6", change).where(F.col("change_e6") > ratio * 1e6)
