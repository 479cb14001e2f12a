import corpus_pipeline
from ratecard.llm.common import table
from ratecard.llm.decontamination import normal
from tests.conftest import SF
from tests.llm.test_jaccard_join import brute_force
from tests.llm.test_tokens import check_pieces, library  # noqa: F401


def test_stages_in_turn(spark, library):  # noqa: F811
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "decontamination", "packing"]

    clean = stages["toxicity"](spark, docs, SF).persist()
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    kept = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in docs.collect()} - kept
    assert clean.columns == columns and len(gone & toxic) >= 0.6 * len(toxic) and len(gone - toxic) <= 0.1 * docs.count()

    single = stages["ngram_jaccard_join"](spark, clean, SF).persist()
    components = brute_force([(r.doc_id, r.text) for r in clean.collect()])
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in components.items() if c == d}

    safe = stages["decontamination"](spark, single, SF).persist()
    items = [normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in safe.collect()}
    assert safe.columns == columns
    assert not any(x in normal(r.text) for r in safe.collect() for x in items if len(x) >= 24)
    assert len(left) >= 0.7 * single.count()

    pieces = stages["packing"](spark, safe, SF).collect()
    check_pieces(pieces, {r.doc_id: r.text for r in safe.collect()}, library)
    assert {r.doc_id for r in pieces} == left

    whole = corpus_pipeline.run(spark, SF).collect()
    check_pieces(whole, {r.doc_id: r.text for r in safe.collect()}, library)
    assert {r.doc_id for r in whole} == left


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "b " * 30, "b"), (None, "b " * 30, "c"), (2, "", "d"), (3, "b " * 30, "e"), (4, "long words stand here " * 30_000, "f"), (5, "c", "g"), (5, "c", "g")], "doc_id long, text string, component string")
    for name, stage in corpus_pipeline.STAGES:
        assert name == "packing" or stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sum(r.length for r in pieces if r.doc_id == 4) == 4 * 30_000 + 1
    assert sorted((r.doc_id, r.length) for r in pieces if r.doc_id in (1, 2, 5)) == [(1, 1), (2, 1), (5, 2), (5, 2)]
    assert corpus_pipeline.ngram_jaccard_join(spark, docs, SF).count() == 8
