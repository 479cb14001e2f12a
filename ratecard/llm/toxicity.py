"""Toxicity by maximum-scoring segment search.

*Tokens* are the letters of lower-cased stretches of non-space. Each has a chain
of ever longer prefixes, up to the word itself. From documents that hold it with
either label, every prefix gets a toxic share under a Dirichlet (here beta)
prior: ``q = (toxic + alpha * q_parent) / (toxic + clean + alpha)``, where the
parent is the next shorter prefix and the root the share of all documents. The
score of a token is the log-odds of the longest prefix that is known, where that
is positive and at least ``least_z`` standard errors from the root; all other
tokens share one slightly negative score, the log-odds of not being a hit.

*Segments*: one linear scan over a document's token scores finds all maximal
scoring segments (Ruzzo and Tompa; of stretches with equal scores the shortest).
*Calibration*: under the clean token
distribution lambda solves sum p * exp(lambda * s) = 1, so a segment of score S
in a document of n tokens has an expected number of chance equals of
``E = K * n * exp(-lambda * S)``. K is the value under which the best segments of the
clean training documents are likeliest, a document without a hit being known only
to have none. Segments of an E below ``significant`` are toxic passages.
The document's score is a logistic function of the best segment's and all
passages' normalised scores, -log E. Lambda, K, the logistic weights and the bias
(so that the threshold is where F1 is best) are fitted by cross-fitting: the training
rows have two halves, and each is scored with the tokens learnt from the other.
The tokens that documents are scored with are learnt from both.

The training rows are labelled rows with ``crc32(doc_id as text) mod 4 <> 2``;
at most about ``sample`` of them, chosen by a hash of doc_id, are used: the
classifier's documented bound. At most ``most_tokens`` prefixes make the model.
Every document is scored over its whole text.

Defined cases: null and empty texts have no token and get the score of a
document without hits; a doc_id labelled twice counts as toxic if one label says
so; null labels are no labels; without any toxic or clean training row all
scores are the prior share of toxic rows (0 if there is none); repeated rows are
scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved, table
from .tokens import release

PREFIXES = (4, 5, 6, 7, 9)
THRESHOLD = 0.3
ALPHA = 4.0
LEAST_Z = 3.0
SAMPLE = 40_000
MOST_TOKENS = 50_000
FEATURES = 4
SCORED = (
    "doc_id bigint, score double, predicted int, n_tokens int, "
    "passages array<struct<first_token: int, last_token: int, score: double, expected: double>>"
)


def letters(stretch: str) -> str:
    """The stretch without anything but letters at its ends."""
    a, b = 0, len(stretch)
    while a < b and not stretch[a].isalpha():
        a += 1
    while b > a and not stretch[b - 1].isalpha():
        b -= 1
    return stretch[a:b]


def chain(word: str) -> list[str]:
    """Its prefixes, short to long; the word itself, marked as whole, last."""
    return [word[:k] + "~" for k in PREFIXES if len(word) > k] + [word]


def segments(hits: list[tuple[int, float]], n: int, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of n tokens, as (first, last, score), ties to the shortest.

    ``hits``: places and positive scores; every other token scores ``-gap``.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sums before and after
    links: list[int] = []  # for each, the nearest earlier one whose sum before is less
    total, place = 0.0, 0
    for at, score in hits:
        total -= gap * (at - place)
        place = at + 1
        first, before = at, total
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = links[j]
            if j < 0 or found[j][3] >= total:
                found.append((first, at, before, total))
                links.append(j)
                break
            first, before = found[j][0], found[j][2]
            del found[j:], links[j:]
    return [(a, b, after - before) for a, b, before, after in found]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    gap: float = 0.01
    rate: float = 1.0  # lambda
    k: float = 0.1
    weights: tuple[float, ...] = ()
    prior: float = 0.0
    significant: float = 0.05
    memo: dict[str, float] = field(default_factory=dict)

    def token(self, stretch: str) -> float:
        word, out = letters(stretch), 0.0
        if word:
            for unit in reversed(chain(word)):
                known = self.scores.get(unit)
                if known is not None:
                    out = max(known, 0.0)
                    break
        if len(self.memo) > 200_000:
            self.memo.clear()
        if len(stretch) < 64:
            self.memo[stretch] = out
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = (text or "").lower().split()
        known, hits = self.memo.get, []
        for i, s in enumerate(map(known, words)):
            if s is None:
                s = self.token(words[i])
            if s:
                hits.append((i, s))
        return len(words), segments(hits, len(words), self.gap)

    def normalised(self, score: float, n: int) -> float:
        return self.rate * score - np.log(self.k * max(n, 1))

    def features(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        best = max((s for _, _, s in found), default=0.0)
        own = [max(0.0, self.normalised(s, n)) for _, _, s in found]
        return [1.0, self.rate * best / 10, self.normalised(best, n) / 10 if best else -1.0, float(np.log1p(sum(own)))]

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        if not self.weights:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(n, found)), -30, 30))))


def token_scores(counts: dict[str, tuple[int, int]], toxic: int, clean: int, alpha: float = ALPHA, least_z: float = LEAST_Z) -> dict[str, float]:
    """Log-odds of the units against the root; 0 for those too uncertain."""
    root = toxic / (toxic + clean)
    share: dict[str, float] = {}

    def of(unit: str) -> float:
        if unit not in share:
            a, b = counts.get(unit, (0, 0))
            word = unit.rstrip("~")
            above = [p for p in chain(word)[:-1] if len(p) < len(unit) + (not unit.endswith("~"))]
            q = of(above[-1]) if above else root
            share[unit] = (a + alpha * q) / (a + b + alpha)
        return share[unit]

    out = {}
    for unit, (a, b) in counts.items():
        q = of(unit)
        odds = np.log(q / (1 - q)) - np.log(root / (1 - root))
        error = np.sqrt(1 / (a + alpha * root) + 1 / (b + alpha * (1 - root)))
        out[unit] = float(odds) if odds > 0 and odds >= least_z * error else 0.0
    return out


def _background(model: Model, tallies: Counter, toxic_rate: float) -> None:
    """Gap score and lambda from the clean documents' tokens (score -> number)."""
    n = sum(tallies.values())
    hits = [(s, c / n) for s, c in tallies.items() if s > 0]
    clean_rate = sum(p for _, p in hits)
    mean = sum(s * p for s, p in hits)
    gap = np.log1p(-min(clean_rate, 0.5)) - np.log1p(-min(max(toxic_rate, 2 * clean_rate), 0.9))
    model.gap = float(max(gap, 0.005, 1.5 * mean / max(1e-9, 1 - clean_rate)))
    if not hits:
        return
    low, high = 1e-6, 1.0
    excess = lambda x: sum(p * np.exp(min(x * s, 500)) for s, p in hits) + (1 - clean_rate) * np.exp(-x * model.gap) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    model.rate = float(high)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_tokens: int = MOST_TOKENS) -> Model:
    """The model from labelled rows; see the module's text for what is used."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    total = known.count()
    part = F.abs(F.xxhash64("doc_id") % 1_000_000)
    if total > sample:
        known = known.where(part < int(1_000_000 * sample / total))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # the bounded sample with its texts; every later step reads it instead of the corpus
    rows = saved(rows.select((part % 2).cast("int").alias("fold"), "toxic", "text"), "sample")
    sizes = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((0, 1), 0) + sizes.get((1, 1), 0), sizes.get((0, 0), 0) + sizes.get((1, 0), 0)
    model = Model(prior=toxic / max(1, toxic + clean))
    if not toxic or not clean:
        forget(rows)
        return model

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int32()) for i in range(4))], names=["unit", "c00", "c01", "c10", "c11"])

        for batch in batches:
            for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = {u for w in set((text or "").lower().split()) for u in chain(letters(w)) if u}
                for u in own:
                    counts.setdefault(u, [0, 0, 0, 0])[2 * fold + y] += 1
            if len(counts) > 200_000:
                yield flush()
                counts = {}
        if counts:
            yield flush()

    kinds = ("c00", "c01", "c10", "c11")
    summed = rows.mapInArrow(units, "unit string, c00 int, c01 int, c10 int, c11 int").groupBy("unit").agg(*(F.sum(c).cast("int").alias(c) for c in kinds))
    a, b, odds = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10"), toxic / clean
    gain = F.log((a + 0.5) / (b + 0.5)) - float(np.log(odds))
    kept = summed.where((a >= 2) & (gain > 0)).orderBy((gain * F.sqrt(a.cast("double"))).desc(), "unit").limit(most_tokens)
    table_ = [(r.unit, (r.c00, r.c01, r.c10, r.c11)) for r in kept.collect()]

    def scores(folds: tuple[int, ...]) -> dict[str, float]:
        counts = {u: (sum(c[2 * f + 1] for f in folds), sum(c[2 * f] for f in folds)) for u, c in table_}
        return token_scores(counts, max(1, sum(sizes.get((f, 1), 0) for f in folds)), max(1, sum(sizes.get((f, 0), 0) for f in folds)))

    model.scores = scores((0, 1))
    crossed = spark.sparkContext.broadcast((scores((1,)), scores((0,))))

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, counts = [Model(scores=s) for s in crossed.value], Counter()
        for batch in batches:
            for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                m = models[fold]
                for w in (text or "").lower().split():
                    s = m.memo.get(w)
                    counts[y, round(m.token(w) if s is None else s, 1)] += 1
        if counts:
            y, s = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(s, pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["toxic", "s", "n"])

    seen = {0: Counter(), 1: Counter()}
    for r in rows.mapInArrow(tallies, "toxic int, s double, n bigint").groupBy("toxic", "s").agg(F.sum("n").alias("n")).collect():
        seen[r.toxic][r.s] += r.n
    all_toxic = max(1, sum(seen[1].values()))
    _background(model, seen[0], sum(c for s, c in seen[1].items() if s > 0) / all_toxic)
    settings = {k: getattr(model, k) for k in ("gap", "rate")}

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, hits, mass = [Model(scores=s, **settings) for s in crossed.value], 0, 0.0
        for batch in batches:
            for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not y:
                    n, found = models[fold].scan(text)
                    best = max((s for _, _, s in found), default=0.0)
                    hits, mass = hits + bool(found), mass + n * math.exp(-models[fold].rate * best)
        yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64()), pa.array([mass], pa.float64())], names=["hits", "mass"])

    seen_best = rows.mapInArrow(extremes, "hits bigint, mass double").agg(F.sum("hits").alias("hits"), F.sum("mass").alias("mass")).first()
    if seen_best.hits:  # three places: the sum depends on the order of arrival in its last ones
        model.k = float(f"{min(1.0, seen_best.hits / seen_best.mass):.3g}")
    settings["k"] = model.k

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(scores=s, **settings) for s in crossed.value]
        for batch in batches:
            x = [models[fold].features(*models[fold].scan(text)) for fold, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            if x:
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*x))], names=["y", *(f"x{i}" for i in range(FEATURES))])

    # a row for each row of the bounded sample
    got = rows.mapInArrow(features, "y int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toArrow()
    forget(rows)
    y, x = np.asarray(got.column("y"), float), np.stack([np.asarray(got.column(f"x{i}")) for i in range(FEATURES)], 1)
    order = np.lexsort((*x.T, y))  # sums must not depend on the order of arrival
    if not 0 < y.sum() < len(y):
        return model
    model.weights = tuple(at_best_f1(logistic(x[order], y[order]), x[order], y[order]))
    return model


def at_best_f1(w: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The weights with a bias that puts the threshold where F1 is best."""
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.concatenate([z[order][1:] < z[order][:-1], [True]])  # ends of equal scores
    at = int(np.argmax(np.where(last, f1, -1)))
    cut = (z[order][at] + z[order][min(at + 1, len(y) - 1)]) / 2
    return w + np.eye(len(w))[0] * (np.log(threshold / (1 - threshold)) - cut)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's score, decision and toxic passages; see ``SCORED``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shipped.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, found = m.scan(text.as_py())
                p = m.probability(n, found)
                passages = [{"first_token": a, "last_token": b, "score": s, "expected": e} for a, b, s in found if (e := float(np.exp(-m.normalised(s, n)))) < m.significant]
                rows.append((p, int(p >= threshold), n, passages))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.float64(), pa.int32(), pa.int32(), pa.list_(span))))], names=["doc_id", "score", "predicted", "n_tokens", "passages"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shipped.value
        for batch in batches:
            yield batch.filter(pa.array([m.probability(*m.scan(text.as_py())) < threshold for text in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by what ``labels.toxic`` says outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
