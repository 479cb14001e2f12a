"""Fill-in-middle: against SQL, plain loops and round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratecard.llm.common import table
from ratecard.llm.fill_in_middle import OP11_SQL, arrange_text, fill_in_middle, op11_fill_in_middle, restore, restore_text, unit_ends
from tests.conftest import SF01
from tests.llm.test_native import same


def brute(doc_id, text):
    """(n, form, prefix, middle, suffix) by the definition, with Python's own re."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, None
    cuts = sorted([h1 % (len(units) + 1), h2 % (len(units) + 1)])
    return len(units), "spm" if h4 % 100 < 20 else "psm", "".join(units[: cuts[0]]), "".join(units[cuts[0] : cuts[1]]), "".join(units[cuts[1] :])


def test_op11_equals_sql(spark):
    same(op11_fill_in_middle(spark, SF01), OP11_SQL, SF01, "documents")


def test_all_forms_are_there_and_texts_come_back(spark):
    docs = table(spark, SF01, "documents")
    made = restore(fill_in_middle(docs)).alias("made").join(docs.alias("was"), "doc_id")
    assert made.where(~F.col("made.text").eqNullSafe(F.coalesce(F.col("was.text"), F.lit("")))).count() == 0
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert op11_fill_in_middle(spark, SF01).where("output_sha256 = restored_sha256 and form <> 'plain'").count() == 0


@settings(max_examples=500, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(st.one_of(st.sampled_from("aZ <PSM>é\n\U0001f600\x00"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_against_the_definition(doc_id, text):
    n, form, prefix_chars, middle_chars, output = arrange_text(str(doc_id), text)
    want = brute(doc_id, text)
    assert (n, form) == want[:2] and restore_text(output, form) == text
    if form != "plain":
        _, _, p, m, s = want
        assert (prefix_chars, middle_chars) == (len(p), len(m))
        assert output == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_odd_rows(spark):
    long = "word, " * 700_000
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, long), (5, "x <P> y"), (6, "<S"), (7, "é" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as form", "1 as n", "'y' as output")
    got = restore(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "text").collect()
    want = []
    for i, t in rows:
        n, form, p, m, _ = brute("" if i is None else i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), t or ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fill_in_middle(docs.limit(0)).count() == 0
    assert fill_in_middle(docs.select(F.col("doc_id").cast("int"), "text")).count() == len(rows)
    assert unit_ends("ab, c").itemsize == 4 and list(unit_ends("ab, c")) == [2, 3, 4, 5]
