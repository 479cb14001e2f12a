"""LM scoring: masked pseudo-likelihood of a bidirectional window network.

The network predicts every token of a text from the tokens on both sides of it,
never from itself; a document's score is the sum of those conditional
log-probabilities. Tokens are words (runs of letters, digits and characters
beyond ASCII, A-Z lower-cased): the ``words`` most frequent ones of the corpus
have an id each, all others share hash ids. The network sums an embedding for each
place of the window, applies tanh, and predicts the id's class and the id within
its class (both normalised exactly). It starts as the corpus's unigram model. To a
token of a shared id its word's share of that id's tokens, counted over all
documents, is added as log P(word | id), so every word has a probability of its
own. Shares of the most frequent words go out with the model, ``SHIPPED`` words at
most; tokens of rarer words meet their counts in a join.

Training is data-parallel, in numpy: in each round every task starts from the
round's weights and trains on its documents, and the tasks' weights are averaged
by their tokens, in a tree whose nodes hold a bounded number of weight sets. Each
document belongs to one round, all documents take part, and every token of a
document is a target in training. Word counts are over all documents; all tokens
of whole texts are scored.

Defined cases: a text without words (or null) has no tokens, a score of 0 and no
mean; repeated rows train and are scored each; rows without a doc_id take part;
an empty table gives no rows; further columns are ignored; a word that was not
counted has the share of a word counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path, table
from .shingles import word_hashes

_APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
SIDE = 3
CLASSES = 32
EACH = 32
DIMENSIONS = 24
SHAPES = {"embed": (2 * SIDE, CLASSES * EACH + 1, DIMENSIONS), "class_w": (DIMENSIONS, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, DIMENSIONS, EACH), "word_b": (CLASSES, EACH)}
_COUNTED = "h bigint, n bigint"
SCORED = "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double, pseudo_perplexity double"
_CHUNK = 200
SHIPPED = 400_000


@dataclass
class Vocabulary:
    """Hashes of the frequent words, sorted, with their ids; other words share the rest of the ids.

    ``counted`` is the path of all words' counts (h, n), ``totals`` the tokens of each id.
    """

    hashes: np.ndarray
    ids: np.ndarray
    counted: str | None = None
    totals: np.ndarray | None = None

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        known = len(self.hashes)
        others = CLASSES * EACH - known
        out = known + ((hashes >> np.uint64(40)) % np.uint64(others)).astype(np.int64)
        if known:
            at = np.minimum(np.searchsorted(self.hashes, hashes), known - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.ids[at[hit]]
        return out


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            piece = batch.slice(at, _CHUNK)
            yield piece, piece.column(column).to_pylist()


def count_words(docs: DataFrame, words: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the number of tokens of each id, over all of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for _, texts in _texts(batches, 0):
            held.append(word_hashes(texts, _APART)[0])
            size += len(held[-1])
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    spark = docs.sparkSession
    path = scratch_path(spark, "words")
    docs.select("text").mapInArrow(run, _COUNTED).groupBy("h").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(path)
    counted = spark.read.schema(_COUNTED).parquet(path)
    top = [(r.h, r.n) for r in counted.orderBy(F.desc("n"), "h").limit(words).collect()]
    hashes = np.array([h for h, _ in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    totals = np.zeros(CLASSES * EACH)
    others = len(totals) - len(top)
    shared = counted.groupBy((len(top) + F.shiftrightunsigned("h", 40) % others).alias("id")).agg(F.sum("n").alias("n"))
    for r in shared.collect():  # one row for each shared id
        totals[r.id] = r.n
    for i, (h, n) in enumerate(top):
        totals[len(top) + (h % (1 << 64) >> 40) % others] -= n
        totals[i] = n
    vocabulary = Vocabulary(hashes[order], np.arange(len(top))[order], path, totals)
    return vocabulary, totals + 0.5


def shipped_shares(spark: SparkSession, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted hashes of the most frequent words, ``SHIPPED`` at most, their counts, and whether these are all words."""
    counted = spark.read.schema(_COUNTED).parquet(vocabulary.counted)
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.step, r.n) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, held = math.inf, 0
    for at, n in sizes:
        if held + n > SHIPPED:
            break
        cut, held = at, held + n
    own = counted.where(step >= cut).toArrow() if held else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    hashes = own.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], own.column("n").to_numpy()[order].astype(np.int32 if held and own.column("n").to_numpy().max() < 1 << 31 else np.int64), held == sum(n for _, n in sizes)


def initial_weights(counts: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Small random embeddings; the biases are the corpus's frequencies."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    own = counts.reshape(CLASSES, EACH)
    w["class_b"] = np.log(own.sum(1) / own.sum()).astype(np.float32)
    w["word_b"] = np.log(own / own.sum(1, keepdims=True)).astype(np.float32)
    w["class_w"] *= np.float32(0.5)
    w["word_w"] *= np.float32(0.5)
    return w


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the ids around it; past the ends of its text, the padding id."""
    pad = CLASSES * EACH
    lengths = np.diff(starts)
    document = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(ids))
    out = np.empty((len(ids), 2 * SIDE), np.int64)
    for k, offset in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = at + offset
        inside = (to >= starts[document]) & (to < starts[document + 1])
        out[:, k] = np.where(inside, ids[np.clip(to, 0, max(0, len(ids) - 1))], pad)
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def hidden(w: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = w["embed"][0][around[:, 0]]
    for k in range(1, 2 * SIDE):
        total = total + w["embed"][k][around[:, k]]
    return np.tanh(total)


def log_probabilities(w: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log P(token | tokens around it) for each token."""
    out = np.empty(len(ids), np.float64)
    for a in range(0, len(ids), 16_384):
        own = ids[a : a + 16_384]
        h = hidden(w, around[a : a + 16_384])
        group, member = own // EACH, own % EACH
        p = _log_softmax(h @ w["class_w"] + w["class_b"])[np.arange(len(own)), group].astype(np.float64)
        order = np.argsort(group.astype(np.int16), kind="stable")
        cut = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in np.unique(group):
            rows = order[cut[c] : cut[c + 1]]
            p[rows] += _log_softmax(h[rows] @ w["word_w"][c] + w["word_b"][c])[np.arange(len(rows)), member[rows]]
        out[a : a + 16_384] = p
    return out


def gradients(w: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Of the summed log-probabilities."""
    n, rows = len(ids), np.arange(len(ids))
    h = hidden(w, around)
    group, member = ids // EACH, ids % EACH
    d_class = -np.exp(_log_softmax(h @ w["class_w"] + w["class_b"]))
    d_class[rows, group] += 1
    g = {"class_w": h.T @ d_class, "class_b": d_class.sum(0), "word_w": np.zeros_like(w["word_w"]), "word_b": np.zeros_like(w["word_b"])}
    d_h = d_class @ w["class_w"].T
    order = np.argsort(group.astype(np.int16), kind="stable")
    cut = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for c in np.unique(group):
        own = order[cut[c] : cut[c + 1]]
        d = -np.exp(_log_softmax(h[own] @ w["word_w"][c] + w["word_b"][c]))
        d[np.arange(len(own)), member[own]] += 1
        g["word_w"][c], g["word_b"][c] = h[own].T @ d, d.sum(0)
        d_h[own] += d @ w["word_w"][c].T
    d_h *= 1 - h * h
    g["embed"] = np.zeros_like(w["embed"])
    for k in range(2 * SIDE):
        order = np.argsort(around[:, k].astype(np.int16), kind="stable")  # 16 bits: a radix sort
        first = np.flatnonzero(np.concatenate([[True], np.diff(around[order, k]) > 0])) if n else []
        if n:
            g["embed"][k][around[order[first], k]] = np.add.reduceat(d_h[order], first, axis=0)
    return g


def train_on(w: dict[str, np.ndarray], chunks: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, batch: int) -> int:
    """Adagrad over (contexts, ids) in place; returns the number of targets."""
    power = {k: np.full_like(v, 1e-2) for k, v in w.items()}
    seen = 0
    for around, ids in chunks:
        for a in range(0, len(ids), batch):
            part = ids[a : a + batch]
            for k, g in gradients(w, around[a : a + batch], part).items():
                g /= math.sqrt(len(part))
                power[k] += g * g
                w[k] += rate * g / np.sqrt(power[k])
            seen += len(part)
    return seen


def _pack(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in SHAPES)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k, s in SHAPES.items():
        size = math.prod(s)
        out[k] = flat[at : at + size].reshape(s).copy()
        at += size
    return out


def _averaged(parts: DataFrame, n: int) -> dict[str, np.ndarray] | None:
    """The mean of (leaf, seen, weights) rows, weighted by ``seen``."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, leaf = None, 0, None
        for batch in batches:
            for at, count, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(data, np.float32).astype(np.float64) * count
                total = own if total is None else total + own
                seen, leaf = seen + count, at if leaf is None else leaf
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], names=["leaf", "seen", "weights"])

    schema = "leaf bigint, seen bigint, weights binary"
    while n > 16:
        n = math.ceil(math.sqrt(n))
        parts = parts.repartition(n, "leaf").sortWithinPartitions("leaf").mapInArrow(combine, schema)
    rows = sorted((r.leaf, r.seen, bytes(r.weights)) for r in parts.collect())  # 16 at most
    if not rows:
        return None
    total = sum(r[1] for r in rows)
    return _unpack(sum(np.frombuffer(r[2], np.float32) * np.float64(r[1] / total) for r in rows).astype(np.float32).tobytes())


def train(docs: DataFrame, words: int = 768, rounds: int = 3, rate: float = 0.08, batch: int = 8192, seed: int = 11) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Vocabulary and weights from all of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    vocabulary, counts = count_words(docs, words)
    w = initial_weights(counts, seed)
    for r in range(rounds):
        shipped = spark.sparkContext.broadcast((Vocabulary(vocabulary.hashes, vocabulary.ids), _pack(w)))
        own = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            known, data = shipped.value
            mine = _unpack(data)

            def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for _, texts in _texts(batches, 0):
                    hashes, starts = word_hashes(texts, _APART)
                    ids = known.encode(hashes)
                    yield contexts(ids, starts), ids

            seen = train_on(mine, chunks(), rate, batch)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([_pack(mine)], pa.binary())], names=["leaf", "seen", "weights"])

        trained = own.select("text").mapInArrow(run, "leaf bigint, seen bigint, weights binary")
        w = _averaged(trained, trained.rdd.getNumPartitions()) or w
    return vocabulary, w


def score(docs: DataFrame, model: tuple[Vocabulary, dict[str, np.ndarray]]) -> DataFrame:
    """Every document's pseudo-likelihood; see ``SCORED``."""
    spark, vocabulary = docs.sparkSession, model[0]
    words, counts, whole = shipped_shares(spark, vocabulary)
    shipped = spark.sparkContext.broadcast((vocabulary, _pack(model[1]), words, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, data, words, counts = shipped.value
        w = _unpack(data)
        log_totals = np.log(np.maximum(known.totals, 1))
        row = TaskContext.get().partitionId() << 40
        for piece, texts in _texts(batches, 1):
            hashes, starts = word_hashes(texts, _APART)
            ids = known.encode(hashes)
            p = log_probabilities(w, contexts(ids, starts), ids)
            shared = np.flatnonzero(ids >= len(known.hashes))
            p[shared] -= log_totals[ids[shared]]
            rest = np.ones(len(shared), bool)
            if len(words):
                distinct, back = np.unique(hashes[shared], return_inverse=True)
                at = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
                hit = words[at] == distinct
                p[shared] += np.where(hit, np.log(counts[at]), 0.0)[back]
                rest = ~hit[back]
            sums = np.concatenate([[0.0], np.cumsum(p)])
            far = shared[rest]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, starts).astype(np.int32)), pa.array(hashes[far].view(np.int64)))
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, piece.column(0), pa.array(np.diff(starts)), pa.array(sums[starts[1:]] - sums[starts[:-1]]), lists], names=["row", "doc_id", "n", "total", "rest"])

    out = docs.mapInArrow(run, "row bigint, doc_id bigint, n bigint, total double, rest array<bigint>")
    if not whole:
        out = saved(out, "scored")
        counted = spark.read.schema(_COUNTED).parquet(vocabulary.counted)
        rare = out.select("row", F.explode("rest").alias("h")).join(counted, "h").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        out = out.join(rare, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return out.select("doc_id", F.col("n").alias("n_tokens"), F.col("total").alias("log_likelihood"), mean.alias("mean_log_likelihood"), F.exp(-mean).alias("pseudo_perplexity"))


def score_corpus(docs: DataFrame, **training) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, train(docs, **training))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, scored by a network trained on all of them."""
    return score_corpus(table(spark, sf_dir, "documents"))
