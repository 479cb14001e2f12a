import random
import re
from fractions import Fraction

import numpy as np
import pytest

from ratecard.llm import jaccard_join as jaccard_module
from ratecard.llm.common import table
from ratecard.llm.components import connected_components
from ratecard.llm.jaccard_join import REACH, jaccard_join, op4_ngram_jaccard_join, reach_needed
from ratecard.llm.shingles import shingle_sets
from tests.conftest import SF


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_force(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= 80 * (len(s) + len(t) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def same(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    want = brute_force(rows)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {} and len(got) == len(want)


def test_shingle_sets():
    texts = ["A b c d e f", None, "", " x  y ", "a B c D e f", "Ünïcode É é a b c", " a b\x0bc d e", "a " * 9]
    sets = [frozenset(s.tolist()) for s in shingle_sets(texts)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[0] == sets[4]


def test_reach():
    assert max(reach_needed(n, Fraction(4, 5)) for n in range(4, 5000)) <= REACH


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 540)] + [(1000, 1001 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def mutated(rng, words, share):
    return " ".join("w%d" % rng.randrange(10**6) if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def hard():
    """Copies, near copies around the threshold, shared passages and a few odd texts."""
    rng = random.Random(5)
    text = lambda n: ["t%d" % rng.randrange(5000) for _ in range(n)]
    rows, passage = [], text(60)
    for base in (text(120), text(30), text(400)):
        rows += [mutated(rng, base, s) for s in (0, 0.004, 0.01, 0.02, 0.03, 0.05) for _ in range(12)]
        rows += [" ".join(base)] * 5
    rows += [" ".join(text(rng.randrange(1, 40)) + passage + text(rng.randrange(1, 40))) for _ in range(40)]
    rows += [" ".join(passage[: rng.randrange(50, 61)]) for _ in range(20)]
    rows += ["", None, " \n", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e f", "word " * 3000, "word " * 2999]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("group, most", [(32, 1 << 20), (4, 1 << 20), (2, 40)])
def test_against_brute_force(spark, hard, group, most):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in hard], "doc_id long, text string, n_shingles string, component_id int")
    same(jaccard_join(docs, group=group, most_frequent=most), hard)


def test_clusters_ship_only_what_sketches_leave(spark, monkeypatch):
    """Texts that share passages, so that keys of many classes connect them, but that are far apart: none is shipped, few links are lost."""
    rng = random.Random(8)
    shared = ["p%d" % i for i in range(166)]
    rows = [(i, " ".join(shared + ["u%d_%d" % (i, k) for k in range(38)])) for i in range(300)]
    large = ["q%d" % i for i in range(1500)]
    rows += [(1000 + i, " ".join(mutated(rng, large, s).split() + ["v%d" % i])) for i, s in enumerate((0, 0.02, 0.02, 0.06, 0.01))]
    wanted, find = [], jaccard_module._texts_of

    def texts_of(docs, ids):
        wanted.append({r.id for r in ids.select("id").collect()})
        return find(docs, ids)

    monkeypatch.setattr(jaccard_module, "_texts_of", texts_of)
    same(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), group=4), rows)
    assert len(wanted) == 3 and not any(i < 300 for i in wanted[2])


def test_pairs_of_a_bucket_in_runs():
    """A bucket whose keys give 2.4 million pairs is paired in runs that each give about a million at most."""
    size = np.full(5000, 32)
    first = np.cumsum(size) - size
    pairs = size * (size - 1) // 2
    runs = jaccard_module._runs(pairs, first, int(size.sum()))
    assert [r.start for r in runs[1:]] == [r.stop for r in runs[:-1]] and (runs[0].start, runs[-1].stop) == (0, size.sum())
    assert len(runs) == 3 and max(pairs[(first >= r.start) & (first < r.stop)].sum() for r in runs) <= (1 << 20) + 496


@pytest.mark.parametrize("bits", [12, 14, 16])
def test_folded_sketches(bits):
    tokens = np.unique(np.random.default_rng(bits).integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2))
    fine, coarse = jaccard_module._sketch(tokens, bits), jaccard_module._sketch(tokens, 10)
    assert jaccard_module._folded(fine[None, :], 16).tolist() == [coarse.tolist()]


def test_documents(spark):
    same(op4_ngram_jaccard_join(spark, SF), [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()])


def test_empty(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard_join(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).count() == 0
