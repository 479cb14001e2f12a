"""One search: from typed text to ranked products, facet counts and chips.

The text is parsed when the query is planned, and the candidates (offers of the
region and category, with what the text index says) are written once, as a cache of
this search. The rest are lazy plans over them; a caller acts on the page and on the
counts. Where nothing matches, what stands in is found in the same plan. ``search_batch`` does
many searches at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import column_sorts, facets, ranking
from .query_parse import RELAXATION, Query, parse


#: Relevance and match of results that stand in for none: with constraints relaxed, and of the category alone.
RELAXED, CATEGORY_ONLY = 0.3, 0.2


def fallback(rows: DataFrame, constraints: dict[str, object], attributes: dict[str, Column], order: tuple[str, ...] = RELAXATION, n: int = 24) -> DataFrame:
    """What is shown where nothing matches all of ``constraints``: the rows of the first
    rung of the relaxation ladder that has any, else the ``n`` cheapest of ``rows``.

    ``rung`` says how many constraints were given up (null: all, and what they name
    too). All rungs are tested in one pass: every row carries a flag for each rung,
    and the first rung with a flag is one small aggregate.
    """
    rungs, left = [], dict(constraints)
    for name in order:
        if name in left:
            left = {k: v for k, v in left.items() if k != name}
            rungs.append(dict(left))
    flags = F.array(*(facets.constraints_match(c, attributes)[0] for c in rungs)) if rungs else F.array().cast("array<boolean>")
    flagged = rows.withColumn("_flags", flags)
    first = flagged.agg(*(F.bool_or(F.get("_flags", F.lit(i))).alias(f"r{i}") for i in range(len(rungs))), F.count("*").alias("_rows"))
    rung = F.lit(None).cast("int")
    for i in reversed(range(len(rungs))):
        rung = F.when(F.col(f"r{i}"), F.lit(i)).otherwise(rung)
    first = first.select(rung.alias("_rung"))
    found = flagged.join(F.broadcast(first)).where(F.get("_flags", F.col("_rung"))).drop("_flags")  # one row
    cheapest = rows.join(F.broadcast(first)).where("_rung is null").orderBy("landed_minor", "offer_key").limit(n)
    both = found.unionByName(cheapest)
    given = F.when(F.col("_rung").isNotNull(), F.lit(RELAXED)).otherwise(F.lit(CATEGORY_ONLY))
    return both.withColumns({"relevance": given, "attr_match": given, "rung": (F.col("_rung") + 1).cast("int")}).drop("_rung")


@dataclass
class Search:
    query: Query
    results: DataFrame  # one row for each product, in order; ``rung``: constraints given up (null: all, for the category's cheapest)
    facet_counts: DataFrame | None  # without rows where no category is named or dominant
    chips: DataFrame  # products of each category under the query
    rung: DataFrame  # how far constraints were relaxed, if nothing matched them
    disclosure: str
    weak_match: bool = False
    constraints: dict[str, object] = field(default_factory=dict)
    facet_category: DataFrame | None = None  # the category whose facets apply: named, or of most candidates; or no row


def standing(rows: DataFrame, ok: Column, constraints: dict[str, object], attributes: dict[str, Column], category: str | None, unfound: float = 0.0, n: int = 24) -> DataFrame:
    """Those of ``rows`` (relevance: null where the text index has no hit) that a search shows, with relevance, attr_match and rung.

    All that are ``ok`` among the hits (among all, if there is no hit); if there is
    none, all of the first rung of the ladder; if there is none either and a category
    is named, its ``n`` cheapest. ``unfound``: relevance of a row without a hit that is ok. Every row carries a flag for each case, and which
    case applies is one aggregate, so the cases cost no job each.
    """
    rungs, left = [], dict(constraints)
    for name in RELAXATION:
        if name in left:
            left = {k: v for k, v in left.items() if k != name}
            rungs.append(dict(left))
    flags = F.array(ok, *(facets.constraints_match(c, attributes)[0] for c in rungs))
    hit = F.col("relevance").isNotNull()
    flagged = rows.withColumns({"_flags": flags, "_hit": hit})
    held = [F.bool_or(F.get("_flags", F.lit(i)) & cond).alias(f"{name}{i}") for i in range(len(rungs) + 1) for name, cond in (("h", F.col("_hit")), ("a", F.lit(True)))]
    state = flagged.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any_hit"), *held)
    case = F.lit(None).cast("int")
    for i in reversed(range(len(rungs) + 1)):
        case = F.when(F.when(F.col("_any_hit"), F.col(f"h{i}")).otherwise(F.col(f"a{i}")), F.lit(i)).otherwise(case)
    state = state.select("_any_hit", case.alias("_case"))  # one row
    judged = flagged.join(F.broadcast(state))
    found = judged.where((F.col("_hit") | ~F.col("_any_hit")) & F.get("_flags", F.col("_case")))
    if category is not None:
        found = found.unionByName(judged.where("_case is null").orderBy("landed_minor", "offer_key").limit(n))
    given = F.when(F.col("_case") == 0, F.col("attr_match")).when(F.col("_case") > 0, F.lit(RELAXED)).otherwise(F.lit(CATEGORY_ONLY))
    relevance = F.when(F.col("_case") == 0, F.coalesce("relevance", F.lit(unfound))).when(F.col("_case") > 0, F.coalesce("relevance", F.lit(RELAXED))).otherwise(F.lit(CATEGORY_ONLY))
    return found.withColumns({"attr_match": given, "relevance": relevance}).withColumnRenamed("_case", "rung").drop("_flags", "_hit", "_any_hit")


def search(
    rows: DataFrame,
    text: str,
    attributes: dict[str, Column],
    brands: list[str] | tuple[str, ...] = (),
    relevance: DataFrame | None = None,
    facet_defs: dict[str, tuple[Column, list[str]]] | None = None,
    selected: dict[str, list[str]] | None = None,
    sort: str = "recommended",
    requested: int = 1,
    page: int = 0,
    page_size: int = 24,
    category: str | None = None,
    column: str | None = None,
    descending: bool = False,
) -> Search:
    """``rows``: landed, aged candidates of one region; ``relevance``: (product_id, relevance) of the retrieval.

    Prices, scores and places are those of one list of all candidates, whatever
    their categories. ``category``: asked for beside the text, before what it names.
    ``column``: a column's header (``column_sorts``), over the whole result; equal ones stay in the order of ``sort``.
    """
    if not 1 <= page_size <= 500:
        raise ValueError("a page has 1 to 500 products")
    order = ranking.sort_order(sort, "position")
    query = parse(text, brands)
    category = category or query.category
    found = rows.join(relevance, "product_id") if relevance is not None else rows
    chips = found.groupBy("category").agg(F.countDistinct("product_id").alias("n"))
    rows = rows.join(relevance, "product_id", "left") if relevance is not None else rows.withColumn("relevance", F.lit(None).cast("double"))
    if category:
        rows = rows.where(F.col("category") == category)
    if "cert_state" in rows.columns and "regulated" in rows.columns:
        rows = rows.where(~ranking.hard_filtered(F.col("regulated"), F.col("cert_state")))  # before any count
    rows = stored(rows, "candidates")  # what follows reads them several times
    ok, matched, total = facets.constraints_match(query.constraints, attributes)
    rung = facets.zero_result_rung(rows, query.constraints, attributes, list(RELAXATION))
    named = rows.sparkSession.createDataFrame([(category,)], "category string")
    facet_category = named if category else facets.dominant_category(rows).select("category")
    counts, chosen = None, F.lit(True)
    if facet_defs:
        counted = rows.where(ok & F.col("relevance").isNotNull()) if relevance is not None else rows.where(ok)
        counts = facets.facet_counts(counted, facet_defs, selected or {})
        if not category:
            counts = counts.join(F.broadcast(facet_category.limit(1)))  # one row or none
        counts = counts.select("facet", "value", "n")
        chosen = facets.failing_mask(facet_defs, selected or {}) == 0
    rows = rows.withColumn("attr_match", F.when(total == 0, 0.5).otherwise(matched / F.greatest(total, F.lit(1))))
    shown = standing(rows, ok & chosen, query.constraints, attributes, category, 0.5 if relevance is None else 0.0)
    scored = ranking.score(shown, requested=requested)
    scored = scored.withColumns({"cert_tier": ranking.certification(F.col("cert_state"), 1) if "cert_state" in rows.columns else F.lit(1), "rating_e9": F.floor(F.col("f5") * 1e9 + 0.5)})
    ranked = ranking.banded(scored, [], -F.floor(F.col("score_e9") / 1_000_000), ranking.published_order(), "rank_pos", "row_number").drop("_total")
    wanted = ["freshness", "lead_days", "fetched_at", "rating", "cert_state", "rung"] + ([column_sorts.column_of(column)] if column else [])
    columns = [c for c in dict.fromkeys(wanted) if c in ranked.columns and c not in ("landed_minor", "product_id", "category")]
    products = ranking.by_product(ranked, "category", shown=tuple(columns))
    if sort == "best_value":
        products = ranking.best_value(products)
    if column:
        order = column_sorts.column_sort(column, descending, products.columns, *order)
    page_of = products.orderBy(*order, "product_id").offset(page * page_size).limit(page_size)
    said = f"Sorted by {sort.replace('_', ' ')}; ties by price, age, certification and rating."
    if column:
        said = f"Sorted by {column.replace('_', ' ')}, {column_sorts.direction(column, descending)}; unknown values last, then as {sort.replace('_', ' ')}."
    return Search(query, page_of, counts, chips, rung, said, weak_match=relevance is None and bool(query.terms), constraints=query.constraints, facet_category=facet_category)
