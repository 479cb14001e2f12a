import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ratecard.llm.common import table
from ratecard.llm.decontamination import Matcher, contamination, decontaminate, myers, normal, op10_decontamination, split_item
from tests.conftest import SF


def distance(pattern, text):
    """Sellers: the smallest edit distance to any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (p != c))
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abcd", max_size=90))
def test_myers(pattern, text):
    bits = {c: sum(1 << i for i, x in enumerate(pattern) if x == c) for c in set(pattern)}
    assert myers(bits, len(pattern), text, len(pattern)) == distance(pattern, text)
    assert myers(bits, len(pattern), text, 1) == min(2, distance(pattern, text))


def test_pieces():
    for size in (24, 57, 300):
        for budget in (0, 1, 2, 5, size // 10, size // 4):
            nodes = []
            split_item(0, "x" * size, budget, nodes)
            leaves = sorted((n.start, len(n.text)) for n in nodes if not n.edits)
            assert len(leaves) == budget + 1 and min(n for _, n in leaves) >= size // (budget + 1) - 2
            assert [s for s, _ in leaves] == [sum(n for _, n in leaves[:i]) for i in range(len(leaves))] and sum(n for _, n in leaves) == size


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=8, max_size=40), st.text("ab ", max_size=60), st.integers(0, 6))
def test_matcher_is_exact(item, text, budget):
    item, text = normal(item), normal(text)
    if not item:
        return
    budget = min(budget, len(item) - 1)  # a whole item has no more edits than that
    d = distance(item, text)
    assert Matcher([(1, item)], budget / len(item) + 1e-9).search(text) == ({0: d} if d <= budget else {})


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcxyz")
        elif kind == 1:
            out.insert(i, rng.choice("abcxyz"))
        else:
            del out[i]
    return "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(8, 30))) for i in range(15)] + [(90, " Short"), (91, None), (92, ""), (93, "c++ 11")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(900, None), (901, ""), (902, "x " * 5000), (903, "A short, text"), (904, "shorter"), (905, "In C++  11."), (906, "c++ 112 short")]
    for i in range(15):
        for n in (0, 3, 8, 12, 16, 20):
            docs.append((1000 + 100 * i + n, text(20) + "\n" + edited(rng, items[i][1].upper(), n) + "  " + text(20)))
    want = {(d, i, distance(normal(x), normal(t))) for d, t in docs for i, x in items if len(normal(x)) >= 24 and normal(t)}
    budget = {i: int(0.1 * len(normal(x))) for i, x in items}
    want = {w for w in want if w[2] <= budget[w[1]]}
    want |= {(903, 90, 0), (906, 90, 0), (905, 93, 0)}  # short ones: whole words
    frame = spark.createDataFrame([(d, t, "y") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, doc_id int")
    for block in (1_000_000, 200):
        assert {(r.doc_id, r.item_id, r.distance) for r in contamination(frame, bench, block_chars=block).collect()} == want
        kept = decontaminate(frame, bench, block_chars=block)
        assert kept.schema == frame.schema
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert len({w[0] for w in want}) >= 40


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, bench).count() == 0
    full = table(spark, SF, "documents")
    assert contamination(full, bench).count() == 0 and decontaminate(full, bench).count() == full.count()
    assert contamination(docs, table(spark, SF, "benchmark")).count() == 0


def test_documents(spark):
    out = {(r.doc_id, r.item_id) for r in op10_decontamination(spark, SF).collect()}
    docs = [(r.doc_id, normal(r.text)) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, normal(r.text)) for r in table(spark, SF, "benchmark").collect()]
    assert {(d, i) for d, t in docs for i, x in items if len(x) >= 24 and x in t} <= out


def whole_words(item, text):
    """The smallest distance of an item to a stretch of whole words, by trying all."""
    apart = lambda i: not (text[max(0, i - 1) : i].isalnum() and text[i : i + 1].isalnum())
    cuts = [i for i in range(len(text) + 1) if apart(i)]
    best = len(item) + 1
    for a in cuts:
        row = list(range(len(item) + 1))
        for b in range(a, len(text)):
            new = [row[0] + 1]
            for j, x in enumerate(item, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != text[b])))
            row = new
            if b + 1 in cuts:
                best = min(best, row[-1])
    return best


def test_short_items_have_a_budget_too():
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinrst+") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    found = 0
    for _ in range(400):
        item = normal(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))))[:23].strip()
        if not item:
            continue
        near = edited(rng, item, rng.randrange(0, 4)) if len(item) > 5 else item
        text = normal(" ".join(rng.choice(words) for _ in range(3)) + rng.choice((" ", "", "x")) + near + rng.choice((" ", "", "s")) + " ".join(rng.choice(words) for _ in range(3)))
        budget, d = int(0.1 * len(item)), whole_words(item, text)
        got = Matcher([(1, item)], 0.1, 24).search(text)
        assert got == ({0: d} if d <= budget else {}), (item, text, got, d)
        found += bool(got) and d > 0
    assert found > 10
    item = "what is the capital of x"[:23]
    assert len(item) == 23 and Matcher([(1, item)], 0.1, 24).search("so: what is teh capital of? yes") == {}
    assert Matcher([(1, "which city is the chief")], 0.1, 24).search("ask which city is the cheif, or") == {0: 2}
