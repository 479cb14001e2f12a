"""Written indexes: what lookups read, and odd texts against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from ratecard.operators import index
from ratecard.operators.retrieval import bm25_scan, substring_scores
from ratecard.sources.scratch import shared_path
from tests.conftest import SF01


def scanned(df):
    """Rows that all file scans of a plan gave, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


@pytest.fixture(scope="module")
def words(spark, documents):
    return index.write_postings(documents, "doc_id", ["text"], shared_path(spark, "words"))


@pytest.fixture(scope="module")
def grams(spark, documents):
    return index.write_trigrams(documents, "doc_id", "text", shared_path(spark, "grams"))


def test_a_lookup_reads_the_pages_of_its_terms(spark, words):
    rows = spark.read.parquet(f"{words}/postings").count()
    for terms in (["licens"], ["mit license"], ["zz"]):
        found = index.found_terms(spark, words, terms, {"text": 1.0})
        assert scanned(found) < rows / 15, terms
        plan = found._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(term" in plan or "EqualTo(term" in plan


def test_lookup_equals_scan(spark, words, documents):
    for terms in (["tion", "license", "the"], ["licens", "qqqq"], ["é"]):
        got = {tuple(r) for r in index.bm25_lookup(spark, words, terms, {"text": 1.0}, top=None).collect()}
        assert got == {tuple(r) for r in bm25_scan(documents, "doc_id", {"text": 1.0}, terms, top=None).collect()}
    assert index.bm25_lookup(spark, words, [], {"text": 1.0}).count() == 0
    assert index.bm25_lookup(spark, words, ["the"], {"text": 1.0}, top=7).count() == 7


def test_trigrams_equal_substrings_and_read_few_texts(spark, grams, documents):
    for terms in (["license", "tion"], ["apache license", "the"], ["nowhere to be found"], ["aaa"], ["er"]):
        got = {tuple(r) for r in index.substring_lookup(spark, grams, terms, top=None).collect()}
        assert got == {tuple(r) for r in substring_scores(documents, "doc_id", "text", terms, top=None).collect()}, terms
    postings = spark.read.parquet(f"{grams}/grams").count()
    assert scanned(index.gram_places(spark, grams, "the")) < postings / 15


ODD = [(1, "aaaa aaa"), (2, None), (3, ""), (4, "ab"), (5, "\U0001f600ab?ab \U0001f600\U0001f600x"), (6, "mit License\nmit, license MIT"), (7, "the mit\tlicensed"), (8, "É é é"), (9, "\U0010ffff\U0010ffffx aba ababa")]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "id long, text string").withColumn("title", F.lit("Mit lic"))
    path = index.write_trigrams(docs, "id", "text", shared_path(spark, "odd"))
    for term in ("aaa", "aba", "?ab", "\U0001f600ab", "\U0001f600\U0001f600x", "mit license", "\U0010ffff\U0010ffffx", "ababa", "xyz"):
        want = {(i, float((t or "").lower().count(term))) for i, t in ODD if term in (t or "").lower()}
        assert {tuple(r) for r in index.substring_lookup(spark, path, [term], top=None).collect()} == want, term
    path = index.write_postings(docs, "id", ["title", "text"], shared_path(spark, "odd"))
    found = {(r.key, r.q): r.f for r in index.found_terms(spark, path, ["mit licens", "mit lic"], {"title": 10.0, "text": 1.0}).collect()}
    for i, t in ODD:
        w = re.findall(r"\w+", (t or "").lower())
        places = sum(w[k] == "mit" and w[k + 1].startswith("licens") for k in range(len(w) - 1))
        assert found.get((i, "mit licens"), 0.0) == places
        assert found[i, "mit lic"] == 10 + sum(w[k] == "mit" and w[k + 1].startswith("lic") for k in range(len(w) - 1))
    assert {r.key for r in index.found_terms(spark, path, ["e"], {"text": 1.0}, prefix=False).collect()} == {8}


def test_bounds_of_prefixes():
    assert index.after_prefix("ab") == "ac" and index.after_prefix("a\U0010ffff") == "b" and index.after_prefix("퟿") == "" and index.after_prefix("\U0010ffff") is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_fuzzy_join_loses_nothing(spark):
    """All words of few letters, and changed ones around the length where keys change."""
    import itertools
    import random

    from ratecard.operators.retrieval import LONG_FORM, near_pairs

    rng = random.Random(5)
    words = {"".join(w) for n in range(5) for w in itertools.product("ab", repeat=n)} | {"\U0001f600ab", "é" * 4}
    for n in (*range(LONG_FORM - 3, LONG_FORM + 5), 40):
        for _ in range(6):
            w = "".join(rng.choice("abc") for _ in range(n))
            words.add(w)
            for _ in range(6):
                v = list(w)
                for _ in range(rng.choice((1, 2, 3))):
                    at = rng.randrange(len(v))
                    v[at : at + rng.choice((0, 1))] = rng.choice(([], ["x"], ["a", "b"]))
                words.add("".join(v))
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.form): r.distance for r in near_pairs(df, df.withColumnRenamed("word", "form")).collect()}
    want = {(a, b): d for a in words for b in words if abs(len(a) - len(b)) <= 2 and (d := edits(a, b)) <= 2}
    assert got == want
