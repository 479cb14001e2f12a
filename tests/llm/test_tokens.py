import gc
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratecard.llm.common import scratch_path, table
from ratecard.llm.jaccard_join import _buckets, _chunks
from ratecard.llm.packing import pack_documents, pack_lengths, step_groups
from ratecard.llm.token_output import op6_token_output, read_tokens, token_digest, write_tokens
from ratecard.llm.tokens import WordEncoder, default_vocabulary, shared_encoder
from tests.conftest import SF, SF01

ODD = ["", None, "A,. B__, c", "İstanbul ŉ ſ ΑΣ, ﬁ x", "<|endoftext|>hi, a\x1cb\x01", "it's, we'LL. Don't_. ok.\n", "a b ½,5. ²", "éa, É. ß ẞ", "é , ,", "x" * 20000, "a " * 30000]


@lru_cache
def library_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    return library_of()


def test_encoder_equals_library(spark, library):
    texts = [r.text for r in table(spark, SF01, "documents").select("text").collect()] + ODD
    for encoder in (WordEncoder(default_vocabulary()), WordEncoder(default_vocabulary(), most=50, longest=5)):
        for text in texts if encoder.most > 50 else texts[-400:]:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text), text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbßÄéñ.,'_!? \n\t-1½İ\u0301\x1c\x01"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_random_texts(texts):
    encoder, whole = shared_encoder(default_vocabulary()), library_of()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == [whole(t) for t in texts]


def test_signs_after_words_are_asked_for_apart(library, monkeypatch):
    """A known word with signs behind it is not asked for again, only the signs once."""
    encoder, asked = WordEncoder(default_vocabulary()), []
    encoder.encode("alpha beta")
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words, others: asked.append((sorted(words), sorted(others))) or learn(words, others))
    texts = ["Alpha$$$ beta!! gamma!! it's!! <|endoftext|>!! x1!!", "ÄÖ$$$ e\u0301!! gamma $$$"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == [library(t) for t in texts]
    assert len(asked) == 1 and not {"alpha", "beta", "alpha$$$", "beta!!", "gamma!!"} & {x for kept in asked[0] for x in kept}
    assert all((asked[0][0] + asked[0][1]).count(x) == 1 for x in ("gamma", "!!", "$$$"))


def odd_documents(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(ODD)] + [(3, "again", "x", 1), (None, "none", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, ids int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file_round_trip(spark, library):
    docs = odd_documents(spark)
    out = token_digest(read_tokens(spark, write_tokens(docs, scratch_path(spark, "t")))).collect()
    want, start = [], 0
    for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library(t) + [2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_token_file_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_digest(read_tokens(spark, write_tokens(docs, scratch_path(spark, "t")))).count() == 0


def test_op6_over_documents(spark, library):
    out = {r.doc_id: r for r in op6_token_output(spark, SF).collect()}
    start = 0
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = library(r.text) + [2]
        assert (out[r.doc_id].start, out[r.doc_id].n_tokens, out[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_pieces(rows, texts, library):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, t in texts.items():
        ids, at = library(t) + [1], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, len(by_sequence)


def test_packing(spark, library):
    docs = odd_documents(spark).where("doc_id is not null and text <> 'again' or text is null")
    check_pieces(pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, library)
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for group in (1 << 20, 5000):
        padding, n = check_pieces(pack_documents(docs, group_tokens=group).collect(), texts, library)
        assert padding <= 2048 * 8 and n > 20


def test_packing_repeated_rows_and_no_doc_id(spark, library):
    """Repeated rows are packed each, rows without a doc_id too: every one has all its ids."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (None, None), (2, "")], "doc_id long, text string")
    rows = pack_documents(docs).collect()
    want = sorted((d or -1, len(library(t)) + 1) for d, t in ((r.doc_id, r.text) for r in docs.collect()))
    assert sorted((r.doc_id or -1, r.length) for r in rows) == want
    assert all(r.start == 0 and r.length == r.doc_tokens for r in rows)


def test_packing_empty_and_steps(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack_lengths([]) == ([], [])
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.lognormal(5, 1.5, 3000)]
    sequences, over = pack_lengths(lengths, last=False)
    assert all(sum(p[2] for p in parts) == tier for tier, parts in sequences)
    assert sum(x[2] for x in over) + sum(t for t, _ in sequences) == sum(lengths) and sum(x[2] for x in over) < 256
    steps = step_groups(sequences, 1 << 15)
    cost, size = defaultdict(int), defaultdict(int)
    for (tier, parts), s in zip(sequences, steps):
        size[s] += tier
        if tier == 2048:
            cost[s] += sum(p[2] ** 2 for p in parts)
    assert max(size.values()) <= 1 << 15
    assert max(cost.values()) < 1.6 * sorted(cost.values())[len(cost) // 2]


def test_collections_pause_while_texts_are_encoded_and_far_words_are_remembered(monkeypatch):
    """A word that 370,000 others came after is not asked for again; no garbage is collected meanwhile."""
    encoder, asked = WordEncoder(default_vocabulary()), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words, others: asked.append((len(words), gc.isenabled())) or learn(words, others))
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[i // 20**k % 20] for k in range(5)) for i in range(370_000)]
    first = encoder.encode("zymurgy")
    for at in range(0, len(words), 10_000):
        encoder.encode(" ".join(words[at : at + 10_000]))
    assert encoder.encode("zymurgy") == first and sum(n for n, _ in asked) == 370_001
    assert not any(on for _, on in asked) and gc.isenabled()


def test_tasks_that_encode_nothing_let_encoders_go():
    for own in (_chunks(iter([])), _buckets(iter([]), 4)):
        shared_encoder(default_vocabulary())
        assert shared_encoder.cache_info().currsize and not list(own)
        assert shared_encoder.cache_info().currsize == 0
