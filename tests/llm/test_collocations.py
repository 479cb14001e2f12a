"""Phrase collocations: against SQL, and against plain loops on odd texts."""

import re
from collections import Counter

import pytest

from ratecard.llm import collocations
from ratecard.llm.collocations import OP13_SQL, Shard, merge_runs, mine_collocations, op13_phrase_collocations, phrase_counts
from tests.conftest import SF01
from tests.llm.test_native import same


def brute(rows, least, covered, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        s, k = min((1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        holders = [b for (x, h), b in f.items() if x == lang and len(h) > len(g) and b >= least and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if not any(100 * b >= covered * a for b in holders):
            found.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], s))
    out = []
    for lang in sorted({x[0] for x in found}):
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(out)


def mined(spark, rows, least=2, covered=50, top=40):
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'x' as phrase", "2 as a")
    return sorted(tuple(r) for r in mine_collocations(docs, least, covered, top).collect())


ODD = [
    ("en", "The big red fox. The big red fox, the big\tred FOX! a b a b a b a b"),
    ("en", "a a a a a a"),
    ("en", "a a a a a a"),
    (None, "no language here no language here"),
    ("und", "no language there"),
    ("de", None),
    ("de", ""),
    ("de", " .,;:!? \n\r\t "),
    ("fr", "x\x00y z x\x00y z\x01 x\x00y z É é É é İ x\x0bé É é"),
    ("l\tx", "one two one two one two one two three one two three"),
    ("en", "q" * 5000 + " w " + "q" * 5000 + " w"),
]


def test_op13_equals_sql(spark):
    same(op13_phrase_collocations(spark, SF01), OP13_SQL, SF01, "documents")


@pytest.mark.parametrize("tokens", [1_000_000, 3, 7])
def test_odd_rows_against_brute_force(spark, monkeypatch, tokens):
    """Tries of a few tokens cut pieces and texts anywhere."""
    if tokens == 1_000_000:
        assert mined(spark, ODD) == brute(ODD, 2, 50, 40)
        assert mined(spark, ODD, 3, 101, 2) == brute(ODD, 3, 101, 2)
        assert mined(spark, [("en", None)][:0] or [("en", "")]) == []
        assert mine_collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    monkeypatch.setattr(collocations, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(collocations, "BLOCK", tokens * 2)
    runs: dict = {}
    shard = Shard(3)
    out = [b for lang, text in ODD for b in shard.add(lang or "und", text or "")] + list(shard.flush())
    for b in out:
        r = b.to_pylist()[0]
        runs.setdefault((r["lang"], r["range"]), []).append((r["words"], r["nodes"], r["counts"]))
    want, n = Counter(), Counter()
    for lang, text in ODD:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                want.update((lang or "und", tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    got: dict = {}
    for (lang, at), held in runs.items():
        names, columns, counts, before = merge_runs(held, 1)
        for c, a, b in zip(columns.T.tolist(), counts.tolist(), before.tolist()):
            g = tuple(names[i - 1] for i in c if i)
            if at < 0:
                assert a == n[lang]
                continue
            assert (lang, g) not in got
            got[lang, g] = a
            assert b == (want[lang, g[:2]] if len(g) == 3 else 0)
    assert got == want


def test_counts_are_whole(spark):
    """A text far longer than a trie; every node that is asked for is there once."""
    docs = spark.createDataFrame([("en", "a b c " * 700_000), ("en", "c a")], "lang string, text string")
    got = {tuple(w for w in (r.w1, r.w2, r.w3) if w): (r.a, r.before) for r in phrase_counts(docs, 10).collect()}
    n = 700_000
    assert got == {(): (3 * n + 2, 0), ("a",): (n + 1, 0), ("b",): (n, 0), ("c",): (n + 1, 0), ("a", "b"): (n, 0), ("b", "c"): (n, 0), ("c", "a"): (n, 0), ("a", "b", "c"): (n, n), ("b", "c", "a"): (n - 1, n), ("c", "a", "b"): (n - 1, n)}


def test_products_beyond_64_bits(spark):
    nodes = [("en", None, None, None, 10**13, 0), ("en", "a", None, None, 9 * 10**12, 0), ("en", "b", None, None, 8 * 10**12, 0), ("en", "a", "b", None, 7 * 10**12, 0)]
    df = spark.createDataFrame(nodes, collocations.MERGED)
    assert [r.score for r in collocations.scored_candidates(df).collect()] == [10**6 * (7 * 10**12) ** 2 // (9 * 10**12 * 8 * 10**12)]
