"""Bundles, fallbacks and checks on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from ratecard.operators import bundles, ranking, retrieval
from ratecard.operators.search import fallback
from ratecard.plans import bundles as plans
from ratecard.plans import catalogue
from tests.conftest import SF

L = F.lit


def test_fallback_rungs(spark):
    rows = spark.createDataFrame([("o%d" % i, "b%d" % (i % 3), i, 100 + i) for i in range(30)], "offer_key string, brand string, size int, landed_minor long")
    own = {"brand": F.col("brand"), "size_mm": F.col("size"), "diameter_mm": F.col("size")}
    shown = lambda wanted: sorted((r.offer_key, r.rung, r.relevance) for r in fallback(rows, wanted, own, n=2).collect())
    assert shown({"size_mm": 99, "brand": "b1", "diameter_mm": 4}) == [("o4", 1, 0.3)]
    assert shown({"size_mm": 4, "brand": "none", "diameter_mm": 4}) == [("o4", 2, 0.3)]
    assert shown({"nothing": 1}) == [("o0", None, 0.2), ("o1", None, 0.2)]
    assert fallback(rows.where("false"), {"brand": "b1"}, own).count() == 0


def test_banded_ranks_equal_windows(spark):
    from pyspark.sql import Window

    rows = spark.range(500).select(F.col("id").alias("offer_key"), (F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 97 * 13 + 1).alias("landed_minor")).union(spark.sql("select 900L, 9L, 5L"))
    w = Window.partitionBy("g").orderBy("landed_minor")
    got = ranking.percent_rank(rows, ["g"], ranking.amount_band(F.col("landed_minor")), [F.asc("landed_minor")], "p").withColumn("q", F.percent_rank().over(w))
    assert got.where("p <> q").count() == 0 and got.count() == 501
    order = [F.desc("landed_minor"), F.asc("offer_key")]
    got = ranking.banded(rows, ["g"], -F.floor(F.col("landed_minor") / 50), order, "n", "row_number").withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got.where("n <> m").count() == 0


def test_bm25_scan_equals_index(spark):
    docs = spark.createDataFrame([(1, "the nation Ñandú nation"), (2, "there"), (3, ""), (4, None), (5, "licensed licence tension the the")], "doc_id int, text string")
    terms = ["the", "nan", "licen"]
    a = {r.doc_id: r.score for r in retrieval.bm25_scan(docs, "doc_id", {"text": 2.0}, terms).collect()}
    b = {r.doc_id: r.score for r in retrieval.bm25(retrieval.postings(docs, "doc_id", {"text": 2.0}), "doc_id", terms).collect()}
    assert a == b and set(a) == {1, 2, 5}
    assert [r.doc_id for r in retrieval.bm25_scan(docs, "doc_id", {"text": 1.0}, terms, top=1).collect()] == [max(a, key=lambda k: (a[k], -k))]
    assert retrieval.bm25_scan(docs, "doc_id", {"text": 1.0}, []).count() == 0


def test_card_pictures_and_contradictions(spark):
    pictures = [("p", "o1", "a", 5, 10), ("p", "o2", "b", 1, 10), ("p", "o2", "c", 1, 20), ("p", "o3", "a", 0, 5), *(("p", "o4", "x%d" % i, 9, i) for i in range(20))]
    frame = spark.createDataFrame(pictures, "product_id string, offer_key string, url string, rank int, width int")
    offers = spark.createDataFrame([("o1", "p"), ("o2", "p"), ("o9", "p"), ("o8", "q")], "offer_key string, product_id string")
    got = {r.offer_key: r.pictures for r in bundles.card_pictures(offers, frame).collect()}
    assert got == {"o1": ["a", "c", "b", "x19", "x18"], "o2": ["c", "b", "a", "x19", "x18"], "o9": ["a", "c", "b", "x19", "x18"], "o8": []}
    heads = ["Shree", "Bangur Rockstrong", "ACC"]
    heads = [h.split()[0] for h in heads]
    cases = [("http://x/shree-opc-53.png", "Bangur", "OPC", True), ("http://x/bangur-ppc-1.png", "Bangur", "OPC", True), ("http://x/bangur-opc-1.png", "Bangur", "OPC", False), ("http://x/1.png", "Bangur", "OPC", False), ("http://x/acc-1.png", "Bangur", None, False), (None, "Bangur", "OPC", False), ("http://x/shree.png", None, None, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, brand string, kind string, want boolean")
    assert rows.where(bundles.contradicts(F.col("url"), F.col("brand"), F.col("kind"), heads) != F.col("want")).count() == 0


def test_vendor_table(spark):
    rows = spark.createDataFrame([("a", "x", "in_stock", "CERTIFIED", 5, 1, 4.0, 10), ("b", "x", "out_of_stock", "NOT_DECLARED", None, None, None, 9), ("c", "y", "in_stock", "BRAND_LICENSED", 1, 3, 4.5, 11)], "offer_key string, platform string, stock_state string, cert_state string, moq int, lead_days int, rating double, landed_minor long")
    keys = lambda df: [r.offer_key for r in df.collect()]
    assert keys(bundles.vendor_table(rows, platform="x", in_stock=True)) == ["a"] and len(keys(bundles.vendor_table(rows, certified=True))) == 2
    assert [keys(rows.orderBy(*bundles.vendor_order(k))) for k in ("moq", "eta", "rating")] == [["c", "a", "b"], ["a", "c", "b"], ["c", "a", "b"]]
    with pytest.raises(ValueError):
        bundles.vendor_order("name")


def test_attempts(spark):
    rows = spark.createDataFrame([(429, 10, 1), (503, 10, 1), (403, 1, 1), (200, 0, 0), (200, 10, 0), (200, 10, 3)], "status int, size int, rows int")
    got = [r.o for r in rows.select(bundles.attempt_outcome(F.col("status"), F.col("size"), F.col("rows")).alias("o")).collect()]
    assert got == ["rate_limited", "blocked", "blocked", "empty", "parse_fail", "ok"]


def test_drift(spark):
    a = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "k int, v long")
    b = spark.createDataFrame([(1, 100), (2, 271), (3, 0)], "k int, v long")
    assert [(r.k, r.change_e6) for r in bundles.identity_drift(a, b, "k", "v").collect()] == [(2, 996949)]


def numbers(text):
    bare = re.sub(r"(?m)^\s{0,6}\d{1,2}[.)]\s", "", text or "")
    return [float(x.replace(",", "")) for x in re.findall(r"(?<![\w.])(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?!\w)", bare)]


def test_ground_numbers_against_brute_force(spark):
    docs = catalogue.table(spark, SF, "documents").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(r.source, r)
    tolerance = lambda x: max(1.0, x * 0.005) if x >= 1000 else 0.5 if x >= 100 else 0.05 if x >= 1 else 0.0
    facts = {s: {y for x in numbers(r.text) for y in (x, float(int(x)), float(-(-x // 1)), round(x), round(x, 1), round(x, 2))} for s, r in first.items()}
    want = {(r.source, x) for r in docs for x in numbers(r.text) if not any(abs(x - f) <= tolerance(abs(x)) + 1e-9 for f in facts[r.source])}
    got = {(r.source, r.number) for r in catalogue.QUERIES["ground_numbers"](spark, SF).collect()}
    assert got == want and want


def test_parsed_queries(spark):
    from ratecard.operators.query_parse import parse

    texts = {(r.conv_id, r.turn): r.text for r in catalogue.table(spark, SF, "conversations").collect()}
    for r in plans.parsed_queries(spark, SF).collect():
        q = parse(texts[r.conv_id, r.turn] or "", ("UltraTech", "Bangur Rockstrong"))
        assert (r.terms, r.category, r.intent) == (" ".join(q.terms), q.category, q.intent)


def test_rules_of_words():
    import re

    from ratecard.functions.wording import chain, followed, whole

    assert whole("a b, c") == " (?:a\\ b|c) "
    assert re.search(followed("a, b", 1, "cd"), " x b y cde ") and not re.search(followed("a, b", 1, "cd"), " b x y cde ")
    assert re.search(chain(("a", 0), ("b", 1)) + " c", " a b x c ") and not re.search(followed("a", 3, "c", go_on=False), " a cd ")


def test_nearest_forms_compare_few(monkeypatch):
    """The forms of a scan over all, though a word that is near to none is compared with hardly any."""
    import random

    from ratecard.operators import query_parse

    rng, forms, brands = random.Random(4), tuple(query_parse.FORMS), ("shree", "bangur rockstrong", "cementa")
    edited = ["".join(c for c in f for c in (c, rng.choice(("", "", c, "x"))) if rng.random() > 0.1) for f in (*forms, *brands) for _ in range(3)]
    scan = lambda w, own: min(((d, i) for i, f in enumerate(own) if (d := query_parse.within_edits(w, f))), default=(0, None))[1]
    nearest = query_parse._nearest(forms, brands)
    for w in edited:
        at, other = scan(w, forms), scan(w, brands)
        assert nearest(w) == (forms[at] if at is not None else brands[other] if other is not None else None), w
    asked = []
    monkeypatch.setattr(query_parse, "within_edits", lambda a, b: asked.append(a))
    query_parse.parse(" ".join("qu%dzwy" % i for i in range(100, 400)), ("UltraTech",))
    assert len(asked) < 300


def test_contradicting_pairs_are_counted_not_paired(spark):
    from tests.compare import difference

    pictures = spark.createDataFrame([(p, u) for p, u in ((1, "x/brand-a.jpg"), (1, "x/brand-b.jpg"), (2, "x/brand-b.jpg")) for _ in range(300)], "product_id int, url string")
    offers = spark.createDataFrame([(p, b) for p, b in ((1, "brand-a"), (1, None), (2, "brand-a"), (3, "brand-a")) for _ in range(200)], "product_id int, brand string")
    df = bundles.pair_contradictions(offers, pictures, ["brand-a", "brand-b"])
    assert {tuple(r) for r in df.collect()} == {("brand-a", 180_000, 120_000), (None, 120_000, 0)}
    joined = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].splitlines() if "Aggregate" in line]
    assert len(joined) == 2  # both sides are counted below the join
    assert not difference(spark, SF, plans.picture_contradictions, catalogue.ORACLES["picture_contradictions"])


def test_card_pictures_read_offers_once(spark):
    df = plans.card_pictures(spark, SF)
    assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString() and "lineitem" not in "".join(df.inputFiles())
