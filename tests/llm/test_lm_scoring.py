import math
import re

import numpy as np

from ratecard.llm import lm_scoring
from ratecard.llm.common import table
from ratecard.llm.lm_scoring import CLASSES, EACH, SIDE, _APART, contexts, count_words, gradients, initial_weights, log_probabilities, op1_lm_scoring, score, train
from ratecard.llm.shingles import word_hashes
from tests.conftest import SF


def slow_log_probability(w, ids, at):
    pad = CLASSES * EACH
    total = np.zeros(w["embed"].shape[2])
    for k, offset in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        j = at + offset
        total += w["embed"][k][ids[j] if 0 <= j < len(ids) else pad]
    h = np.tanh(total)
    c, m = divmod(int(ids[at]), EACH)
    a, b = h @ w["class_w"] + w["class_b"], h @ w["word_w"][c] + w["word_b"][c]
    return a[c] - math.log(sum(math.exp(x) for x in a)) + b[m] - math.log(sum(math.exp(x) for x in b))


def weights(seed=0):
    rng = np.random.default_rng(seed)
    w = initial_weights(rng.random(CLASSES * EACH) + 0.1, seed)
    return {k: v.astype(np.float64) for k, v in w.items()}, rng


def test_log_probabilities_and_gradients():
    w, rng = weights()
    texts = [rng.integers(0, CLASSES * EACH, n) for n in (5, 0, 1, 12)]
    ids, starts = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    around = contexts(ids, starts)
    got = log_probabilities(w, around, ids)
    want = [slow_log_probability(w, t, i) for t in texts for i in range(len(t))]
    assert np.allclose(got, want)
    g = gradients(w, around, ids)
    for k in w:
        for flat in rng.integers(0, w[k].size, 6).tolist() + ([int(np.ravel_multi_index((2, int(around[3, 2]), 1), w[k].shape))] if k == "embed" else []):
            at, e = np.unravel_index(flat, w[k].shape), 1e-5
            old = w[k][at]
            w[k][at] = old + e
            up = log_probabilities(w, around, ids).sum()
            w[k][at] = old - e
            down = log_probabilities(w, around, ids).sum()
            w[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4


def test_predictions_are_distributions():
    w, rng = weights(1)
    around = np.repeat(rng.integers(0, CLASSES * EACH, (1, 2 * SIDE)), CLASSES * EACH, axis=0)
    assert abs(np.exp(log_probabilities(w, around, np.arange(CLASSES * EACH))).sum() - 1) < 1e-6


def test_counts_cover_all(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    vocabulary, counts = count_words(docs, 100)
    words = [w for r in docs.collect() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r.text)]
    assert abs(counts.sum() - 0.5 * len(counts) - len(words)) < 1e-6 * len(words)
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    top = max(set(low), key=low.count)
    assert vocabulary.encode(word_hashes([top], _APART)[0]).tolist() == [0]


def test_training_helps_and_scores_are_whole(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    vocabulary, counts = count_words(docs, 768)
    before = {r.doc_id: r for r in score(docs, (vocabulary, initial_weights(counts, 11))).collect()}
    after = {r.doc_id: r for r in op1_lm_scoring(spark, SF).collect()}
    assert set(before) == set(after) and len(after) == docs.count()
    total = lambda rows: sum(r.log_likelihood for r in rows.values())
    assert total(after) > total(before) * 0.999  # less than the unigram model's loss
    again = {r.doc_id: r for r in score(docs, train(docs)).collect()}
    assert all(abs(again[d].log_likelihood - after[d].log_likelihood) < 1e-3 * abs(after[d].log_likelihood) + 1e-6 for d in after)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " ,. "), (4, "a"), (None, "a b " * 20000), (4, "a")], "doc_id long, text string")
    rows = score(docs, train(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 40000), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert all((r.log_likelihood == 0 and r.mean_log_likelihood is None) if not r.n_tokens else r.log_likelihood < 0 for r in rows)
    empty = docs.where("false")
    assert score(empty, train(empty)).count() == 0


def test_every_token_trains(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "c") for i in range(40)], "doc_id long, text string")
    vocabulary, w = train(docs)
    start = initial_weights(count_words(docs, 768)[1], 11)
    for word in "abc":
        c, m = divmod(int(vocabulary.encode(word_hashes([word], _APART)[0])[0]), EACH)
        assert not np.allclose(w["word_w"][c][:, m], start["word_w"][c][:, m])  # texts of one and two words give targets


def test_every_word_has_a_probability_of_its_own(spark, monkeypatch):
    names = [f"w{i}" for i in range(1500)]
    texts = [" ".join(names), " ".join(names[:1200] * 3), "w3 " * 50 + "w7 w1100", "w3 " * 50 + "w7 w1400"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary, counts = count_words(docs, 2)
    w = initial_weights(counts, 11)
    n = {}
    for word in " ".join(texts).split():
        n[word] = n.get(word, 0) + 1
    encode = lambda words: vocabulary.encode(word_hashes(words, _APART)[0])
    totals = dict.fromkeys(range(CLASSES * EACH), 0)
    for word, i in zip(n, encode([" ".join(n)])):
        totals[i] += n[word]
    for shipped in (10**6, 300, 0):
        monkeypatch.setattr(lm_scoring, "SHIPPED", shipped)
        got = {r.doc_id: r.log_likelihood for r in score(docs, (vocabulary, w)).collect()}
        for d, text in enumerate(texts):
            ids = encode([text])
            want = log_probabilities(w, contexts(ids, np.array([0, len(ids)])), ids).sum()
            want += sum(math.log(n[word] / totals[i]) for word, i in zip(text.split(), ids) if i >= 2)
            assert abs(got[d] - want) < 1e-6 * abs(want)


def test_average_of_weights(spark):
    """A tree of averages is the mean by tokens seen."""
    from ratecard.llm.lm_scoring import SHAPES, _averaged, _pack

    rng = np.random.default_rng(2)
    sets = [{k: rng.standard_normal(s).astype(np.float32) for k, s in SHAPES.items()} for _ in range(20)]
    seen = [int(x) for x in rng.integers(1, 1000, len(sets))]
    parts = spark.createDataFrame([(i, n, _pack(w)) for i, (n, w) in enumerate(zip(seen, sets))], "leaf long, seen long, weights binary")
    got = _averaged(parts, len(sets))
    for k in SHAPES:
        want = sum(w[k].astype(np.float64) * n for n, w in zip(seen, sets)) / sum(seen)
        assert np.allclose(got[k], want, atol=1e-5), k
    assert _averaged(parts.where("false"), 20) is None


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c a", "x", 5, 0.1)], "doc_id long, text string, n_tokens string, row int, total double")
    out = lm_scoring.score_corpus(docs, words=8, rounds=1)
    assert out.columns == ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood", "pseudo_perplexity"] and out.first().n_tokens == 4
