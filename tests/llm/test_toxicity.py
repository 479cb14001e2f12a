import math
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ratecard.llm.common import table
from ratecard.llm.toxicity import MOST_TOKENS, Model, _background, at_best_f1, chain, fit, letters, logistic, op7_toxicity, score_documents, segments, token_scores, without_toxic
from tests.conftest import SF, SF01


def maximal(scores):
    """By definition: the best segment (of equal ones the shortest, then the leftmost), then the same left and right of it."""
    out = []

    def below(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or (total, i - j) > (best[2], best[0] - best[1])):
                    best = (i, j, total)
        if best:
            below(a, best[0])
            out.append(best)
            below(best[1] + 1, b)

    below(0, len(scores))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-3, 3).map(lambda x: 5 * x + 1 if x > 0 else -1), max_size=30))
def test_segments(scores):
    got = segments([(i, s) for i, s in enumerate(scores) if s > 0], len(scores), 1)
    assert [round(s, 6) for _, _, s in got] == [s for _, _, s in maximal(scores)]
    assert all(sum(scores[a : b + 1]) == s for a, b, s in got)


def test_tokens():
    assert [letters(x) for x in ("(Idiot!)", "12", "", "don't,")] == ["Idiot", "", "", "don't"]
    assert chain("abcdefgh") == ["abcd~", "abcde~", "abcdef~", "abcdefg~", "abcdefgh"] and chain("abc") == ["abc"]
    s = token_scores({"idiot": (60, 0), "idio~": (62, 3), "the": (100, 900), "odd": (1, 0)}, 100, 900)
    assert s["idiot"] > s["idio~"] > 1 and s["the"] == 0 and s["odd"] == 0


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op7_toxicity(spark, SF01).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, SF01, "labels").collect()}
    assert len(rows) == table(spark, SF01, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    hit = [(labels[d], r.predicted) for d, r in rows.items() if r.held_out and d in labels]
    precision = sum(y and p for y, p in hit) / max(1, sum(p for _, p in hit))
    recall = sum(y and p for y, p in hit) / sum(y for y, _ in hit)
    print("precision", precision, "recall", recall, len(hit))
    assert precision >= 0.8 and recall >= 0.6


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = (score_documents(docs, fit(docs, x)).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(a) == sorted(b)


def brute_force(docs, labels):
    """The model from plain loops over all training rows."""
    known = {}
    for d, y in labels:
        if d is not None and y in (0, 1) and zlib.crc32(str(d).encode()) % 4 != 2:
            known[d] = max(y, known.get(d, 0))

    def fold(d):
        h = xxhash.xxh64(struct.pack("<q", d), seed=42).intdigest()
        h -= (h >> 63) << 64
        return abs(int(math.fmod(h, 1_000_000))) % 2 if abs(h) < 2**52 else (abs(h) % 1_000_000) % 2

    rows = [(fold(d), known[d], t or "") for d, t in docs if d in known]
    counts, sizes = {}, Counter((f, y) for f, y, _ in rows)
    for f, y, t in rows:
        for u in {u for w in t.lower().split() for u in chain(letters(w)) if u}:
            counts.setdefault(u, [0, 0, 0, 0])[2 * f + y] += 1
    toxic, clean = sizes[0, 1] + sizes[1, 1], sizes[0, 0] + sizes[1, 0]
    gain = {u: math.log((c[1] + c[3] + 0.5) / (c[0] + c[2] + 0.5)) - math.log(toxic / clean) for u, c in counts.items()}
    kept = sorted((u for u, c in counts.items() if c[1] + c[3] >= 2 and gain[u] > 0), key=lambda u: (-gain[u] * math.sqrt(counts[u][1] + counts[u][3]), u))[:MOST_TOKENS]

    def scores(*folds):
        own = {u: (sum(counts[u][2 * f + 1] for f in folds), sum(counts[u][2 * f] for f in folds)) for u in kept}
        return token_scores(own, max(1, sum(sizes[f, 1] for f in folds)), max(1, sum(sizes[f, 0] for f in folds)))

    model, others = Model(scores=scores(0, 1), prior=toxic / (toxic + clean)), [Model(scores=scores(1)), Model(scores=scores(0))]
    seen = {0: Counter(), 1: Counter()}
    for f, y, t in rows:
        seen[y].update(round(others[f].token(w), 1) for w in t.lower().split())
    _background(model, seen[0], sum(c for s, c in seen[1].items() if s > 0) / max(1, sum(seen[1].values())))
    for m in others:
        m.gap, m.rate = model.gap, model.rate
    best = [(len(t.split()), max((s for _, _, s in found), default=None)) for f, y, t in rows if not y for found in [others[f].scan(t)[1]]]
    hits, mass = sum(b is not None for _, b in best), sum(n * math.exp(-model.rate * (b or 0)) for n, b in best)
    if hits:
        model.k = float(f"{min(1.0, hits / mass):.3g}")
    for m in others:
        m.k = model.k
    x, y = np.array([others[f].features(*others[f].scan(t)) for f, _, t in rows]), np.array([float(y) for _, y, _ in rows])
    order = np.lexsort((*x.T, y))
    model.weights = tuple(at_best_f1(logistic(x[order], y[order]), x[order], y[order]))
    return model


def test_scores_against_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = score_documents(docs, fit(docs, labels)).collect()
    assert len(got) == len(texts)
    assert max(abs(r.score - model.probability(*model.scan(texts[r.doc_id]))) for r in got) < 1e-6


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " * 9000, "c")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_documents(docs, fit(docs, none)).collect()] == [0.0] * 4
    model = Model(scores={"idiot": 5.0}, gap=0.05, rate=1.0, weights=(-3.0, 2.0, 2.0, 1.0))
    rows = score_documents(spark.createDataFrame([(5, "You idiot, idiot " + "so " * 50 + "IDIOT.")], "doc_id long, text string"), model).collect()
    assert [(p.first_token, p.last_token) for p in rows[0].passages] == [(1, 53)]
    assert without_toxic(docs, model).count() == 4 and without_toxic(docs, model).schema == docs.schema
    assert score_documents(docs.where("false"), model).count() == 0
