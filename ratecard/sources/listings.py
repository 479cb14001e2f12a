"""Reading listings: JSON lines, captures, dimensions, and pages of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import entities_decoded
from ..operators.reports import latest_per_key

#: A raw listing as its source wrote it; never inferred.
RAW = (
    "source_id string, source_class string, fetch_mode string, source_url string, source_ref string, fetched_at timestamp, region_id string, category string, "
    "platform string, title string, brand string, vendor_name string, vendor_locality string, vendor_city string, vendor_profile_url string, vendor_rating double, "
    "vendor_review_count bigint, seller_type string, price_text string, price_paise bigint, price_unit string, mrp_paise bigint, gst_treatment string, gst_note string, "
    "moq_text string, moq_qty double, moq_unit string, bulk_slabs array<struct<min_qty:double,max_qty:double,paise:bigint>>, stock_state string, lead_time_days int, "
    "specs map<string,string>, images array<string>, datasheet_url string, cert_text string, _bad string"
)


def read_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All well-formed lines; a broken line is passed over."""
    rows = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)
    return rows.where("_bad is null and source_id is not null and source_ref is not null").drop("_bad")


def latest_listings(raw: DataFrame) -> DataFrame:
    """The newest row of each listing."""
    return latest_per_key(raw.withColumn("_specs", F.to_json("specs")).drop("specs"), ["source_id", "source_ref"], "fetched_at", "title").withColumn("specs", F.from_json("_specs", "map<string,string>")).drop("_specs")


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV dimension with a header, columns by name."""
    rows = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return rows.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields))


def captured(raw: DataFrame, category: str, region: str, as_of: Column, stale_days: int = 2) -> DataFrame:
    """Assisted captures of a category and region: rows, newest time and staleness by platform."""
    own = raw.where((F.col("category") == category) & (F.col("region_id") == region))
    return own.groupBy("platform").agg(F.count("*").alias("n"), F.max("fetched_at").alias("newest")).withColumn("stale", F.col("newest") < as_of - F.make_interval(days=F.lit(stale_days)))


def links(pages: DataFrame, include: str, exclude: str | None = None, html: str = "html") -> DataFrame:
    """Distinct link targets of all pages that match."""
    found = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), 1)).alias("url")).where(F.col("url").rlike(include))
    return (found if exclude is None else found.where(~F.col("url").rlike(exclude))).distinct()


def frontier(pages: DataFrame, visited: DataFrame, include: str, exclude: str | None = None) -> DataFrame:
    """Links that were not read yet."""
    return links(pages, include, exclude).join(visited.select("url"), "url", "left_anti")


def crawl_waves(start: DataFrame, read: "callable", include: str, waves: int = 5) -> DataFrame:
    """Breadth-first waves until nothing is new or the cap is met; ``read`` turns urls into pages.

    Each wave is checkpointed (``spark.checkpoint.dir``), so that a wave reads no page of an earlier one again.
    """
    visited = wave = start.select("url").distinct()
    for _ in range(waves):
        wave = frontier(read(wave), visited, include).checkpoint()
        if wave.isEmpty():
            break
        visited = visited.unionByName(wave)
    return visited.distinct()


def new_listings(pages: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("source_id", "source_ref")) -> DataFrame:
    """Of the cards of a pass those that no earlier page or pass had, one of each, the first page's.

    A crawl is over when this is empty: ``passes_done`` says so of a pass.
    """
    order = F.struct("page", *(c for c in ("place",) if c in pages.columns))
    others = [c for c in pages.columns if c not in keys]
    one = pages.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_c")).select(*keys, "_c.*")
    return one.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def passes_done(fresh: list[int], dry: int = 2) -> bool:
    """Whether the last ``dry`` passes found nothing new."""
    return len(fresh) >= dry and not any(fresh[-dry:])


def missed_listings(declared: Column, per_page: Column, pages_read: Column, captured: Column) -> Column:
    """How many listings a source has that were not captured: what it declares, or what its unread pages hold."""
    return F.greatest(F.lit(0), F.coalesce(declared, per_page * pages_read) - captured)


def assets(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, asset, url, width, kind): the widest variant of each picture of a page."""
    url = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)(?:src|href)="([^"]+\.(?:jpe?g|png|webp))"'), 1)).alias("picture")
    rows = pages.select(key, url).withColumn("asset", asset_key(F.col("picture"))).withColumn("width", F.coalesce(F.regexp_extract("picture", r"-(\d+)x\d+\.", 1).try_cast("int"), F.lit(0)))
    best = rows.groupBy(key, "asset").agg(F.max(F.struct("width", "picture")).alias("best"))
    return best.select(key, "asset", "best.picture", "best.width", picture_kind(F.col("best.picture")).alias("kind"))


def asset_key(url: Column) -> Column:
    """The picture's name without host, size suffix and query."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1), r"-\d+x\d+(?=\.)", ""), r"\.[a-zA-Z]+$", "")


def picture_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.rlike("logo|icon"), "logo").when(low.rlike("cert|licen"), "certificate").when(low.rlike("chart|spec"), "chart").otherwise("photo")


_CARD = r'(?s)<(?:div|li)[^>]*class="[^"]*\bcard\b[^"]*"[^>]*>(.*?)</(?:div|li)>'


def parse_cards(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Listing cards: title, price text (a range's low end), unit, rating, minimum order, picture, id.

    One row for each listing id of a page; of its copies the priced one stays.
    """
    cards = pages.select(F.col(url).alias("page_url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_CARD), 1)).alias("place", "card"))
    get = lambda pattern, group=1: F.regexp_extract("card", pattern, group)
    text = lambda c: F.trim(F.regexp_replace(entities_decoded(entities_decoded(F.regexp_replace(c, "<[^>]*>", " "))), r"\s+", " "))
    price = text(get(r'(?s)class="[^"]*price[^"]*"[^>]*>(.*?)</'))
    rows = cards.select(
        "page_url",
        "place",
        text(get(r"(?s)<h[23][^>]*>(.*?)</h[23]>")).alias("title"),
        F.nullif(F.regexp_extract(price, r"([\d,]+(?:\.\d+)?)", 1), F.lit("")).alias("price_text"),
        F.nullif(F.trim(F.regexp_extract(price, r"/\s*([A-Za-z ]+)$", 1)), F.lit("")).alias("unit_text"),
        get(r"(\d(?:\.\d)?)\s*\(\d+\)").try_cast("double").alias("rating"),
        get(r"\d(?:\.\d)?\s*\((\d+)\)").try_cast("bigint").alias("reviews"),
        F.coalesce(get(r"[?&]moq=(\d+)").try_cast("double"), get(r"(?i)min(?:imum)?\.?\s*order[^\d]*(\d+)").try_cast("double")).alias("moq"),
        F.nullif(get(r'<img[^>]*src="([^"]+)"'), F.lit("")).alias("image"),
        F.coalesce(F.nullif(get(r'href="[^"]*?(\d{5,})[^"]*"'), F.lit("")), F.concat_ws("#", "page_url", F.col("place").cast("string"))).alias("source_ref"),
    )
    order = F.struct(F.col("price_text").isNull().alias("unpriced"), "place")
    best = rows.groupBy("page_url", "source_ref").agg(F.min_by(F.struct("title", "price_text", "unit_text", "rating", "reviews", "moq", "image"), order).alias("c"))
    return best.select("page_url", "source_ref", "c.*").where("title <> ''")


def spec_pairs(html: Column) -> Column:
    """MAP of a card's stated specifications: pairs of a term and its description."""
    tag = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
    text = lambda c: F.trim(F.regexp_replace(entities_decoded(entities_decoded(F.regexp_replace(c, "<[^>]*>", " "))), r"\s+", " "))
    keys, values = (F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(i)), text) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: (p.k != "") & (p.v != ""))
    firsts = F.filter(F.transform(pairs, lambda p, i: F.struct(p.k.alias("k"), p.v.alias("v"), i.alias("i"))), lambda p: ~F.array_contains(F.transform(F.slice(pairs, F.lit(1), p.i), lambda q: q.k), p.k))
    return F.map_from_entries(F.transform(firsts, lambda p: F.struct(p.k.alias("key"), p.v.alias("value"))))


#: How other sites write a card: where it is, its title, price, seller; a shop's plugin, and any element that calls itself one.
LAYOUTS = {
    "shop": {"card": r'(?is)<li[^>]*class="[^"]*\bproduct\b[^"]*"[^>]*>(.*?)</li>', "title": r"(?is)<h[23][^>]*>(.*?)</h[23]>", "price": r'(?is)class="[^"]*amount[^"]*"[^>]*>(?:<[^>]*>|[^\d<])*([\d,]+(?:\.\d+)?)(?!.*class="[^"]*amount)', "unit": r"$^", "seller": None},
    "generic": {"card": r'(?is)<(?:div|li|article)[^>]*class="[^"]*(?:product|listing|card)[^"]*"[^>]*>(.*?)</(?:div|li|article)>', "title": r"(?is)<h[234][^>]*>(.*?)</h[234]>", "price": r"₹\s*([\d,]+(?:\.\d+)?)", "unit": r"₹\s*[\d,]+(?:\.\d+)?\s*/\s*([A-Za-z ]{2,18})", "seller": r'(?is)class="[^"]*(?:company|seller|supplier)[^"]*"[^>]*>(.*?)<'},
}


def parse_layout(pages: DataFrame, layout: str, platform: str, html: str = "html", url: str = "url") -> DataFrame:
    """Priced cards of a site of another layout: title, price, unit, seller (the platform itself in a shop), reference.

    Elements of over 3,000 characters of text hold cards and are none; titles of under four characters are none.
    """
    rule = LAYOUTS[layout]
    text = lambda c: F.trim(F.regexp_replace(entities_decoded(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " "))
    cards = pages.select(F.col(url).alias("page_url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rule["card"]), 1)).alias("place", "card"))
    got = lambda pattern: F.regexp_extract("card", pattern, 1)
    rows = cards.where(F.length(text(F.col("card"))) <= 3_000).select(
        "page_url",
        "place",
        text(got(rule["title"])).alias("title"),
        F.regexp_replace(got(rule["price"]), ",", "").try_cast("decimal(18,2)").alias("price"),
        F.nullif(F.trim(got(rule["unit"])), F.lit("")).alias("unit_text"),
        (F.lit(platform) if rule["seller"] is None else text(got(rule["seller"]))).alias("vendor_name"),
        F.coalesce(F.nullif(got(r'href="([^"]+)"'), F.lit("")), F.col("page_url")).alias("source_url"),
    )
    rows = rows.where("length(title) >= 4 and price > 0 and vendor_name <> ''")
    last = F.element_at(F.filter(F.split("source_url", "/"), lambda x: x != ""), -1)
    name = last if rule["seller"] is None else F.concat_ws(":", F.substring("title", 1, 40), F.substring("vendor_name", 1, 30))
    return rows.withColumns({"source_ref": F.concat_ws(":", F.lit(platform), name), "price_paise": (F.col("price") * 100).cast("bigint")}).drop("price", "place").dropDuplicates(["source_ref"])


def challenged(html: Column) -> Column:
    """Whether a page is a check for robots instead of what was asked for."""
    return F.lower(html).rlike("cf-challenge|checking your browser|captcha|attention required|just a moment")


def page_counts(html: Column) -> Column:
    """STRUCT<records, pages> that a page declares of itself."""
    return F.struct(F.regexp_extract(html, r"(?i)(\d[\d,]*)\s+(?:records|products|results)", 1).try_cast("int").alias("records"), F.regexp_extract(html, r"(?i)page\s+\d+\s+of\s+(\d+)", 1).try_cast("int").alias("pages"))


def data_island(pages: DataFrame, path: str, html: str = "html") -> DataFrame:
    """Rows of the JSON array at ``path`` of a page's data script, as VARIANT."""
    raw = F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    listed = F.try_variant_get(F.try_parse_json(raw), path, "array<variant>")
    return pages.select(*[c for c in pages.columns if c != html], F.explode(listed).alias("item"))


def in_city(text: Column, cities: list[str]) -> Column:
    """Whether an address names one of the cities."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(sorted(c.lower() for c in cities)))


def on_topic(title: Column, terms: list[str]) -> Column:
    """Whether a title holds any of a category's terms."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: low.contains(t))


def funnel(rows: DataFrame, in_region: Column, on_topic: Column, priced: Column) -> DataFrame:
    """seen, in_region, on_topic, priced: each within the one before, and why it is empty."""
    a, b, c = in_region, in_region & on_topic, in_region & on_topic & priced
    out = rows.agg(F.count("*").alias("seen"), F.count_if(a).alias("in_region"), F.count_if(b).alias("on_topic"), F.count_if(c).alias("priced"))
    return out.withColumn("outcome", F.when(F.col("seen") == 0, "empty").when(F.col("in_region") == 0, "none in region").when(F.col("on_topic") == 0, "none on topic").when(F.col("priced") == 0, "none priced").otherwise("ok"))


def fetch_failure(status: Column, body: Column) -> Column:
    """Why a page could not be read; null if it could."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when(status == 429, "rate_limited").when(low.rlike("captcha|are you a robot|cf-challenge"), "captcha").when(status.isin(401, 403) | low.rlike("sign in to continue|please log ?in"), "login").when(status == 404, "not_found").when(status >= 500, "server_error").when((status < 200) | (status >= 400), "failed")


def newest_circular(pages: DataFrame, html: str = "html") -> DataFrame:
    """The link of the newest month among a page's table of circulars."""
    months = "january february march april may june july august september october november december".split()
    found = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a[^>]*href="[^"]+"[^>]*>[^<]*?(?:%s)[^<]*\d{4}[^<]*</a>)' % "|".join(months)), 1)).alias("a"))
    month = F.lit(0)
    for i, name in enumerate(months, 1):
        month = F.when(F.lower("a").contains(name), F.lit(i)).otherwise(month)
    rows = found.select(F.regexp_extract("a", r'href="([^"]+)"', 1).alias("url"), (F.regexp_extract("a", r">[^<]*?(\d{4})[^<]*<", 1).cast("int") * 12 + month).alias("at"))
    return rows.agg(F.max_by("url", "at").alias("url"), F.max("at").alias("at"))
