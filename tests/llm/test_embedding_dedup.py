import numpy as np
import pytest

from ratecard.llm.common import table
from ratecard.llm.embedding_dedup import near_duplicates, op2_embedding_dedup, passes_for
from tests.conftest import SF01


def brute_force(rows, threshold=0.9):
    good = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    units = [(i, v / np.abs(v).max()) for i, v in good]
    units = [(i, v / np.linalg.norm(v)) for i, v in units]
    for at, (i, v) in enumerate(units):
        for j, w in units[at + 1 :]:
            if len(v) == len(w) and v @ w >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_documents(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF01, "embeddings").collect()]
    assert result(op2_embedding_dedup(spark, SF01)) == brute_force(rows)


@pytest.mark.parametrize("window", [4, 64])
def test_clusters_wider_than_windows(spark, window):
    rng = np.random.default_rng(4)
    rows = []
    for size, noise in ((700, 0.03), (40, 0.07), (3, 0.01), (2, 0.06)):
        for _ in range(1 if size > 5 else 40):
            center = rng.standard_normal(32)
            rows += [(center + noise * np.sqrt(32) * rng.standard_normal(32) / np.sqrt(32) * np.linalg.norm(center)).tolist() for _ in range(size)]
    rows += [rows[5]] * 100 + rng.standard_normal((300, 32)).tolist()
    rows = [(int(i) * 2 + 1, v) for i, v in zip(rng.permutation(len(rows)), rows)]
    want = brute_force(rows)
    got = result(near_duplicates(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string"), window=window))
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [1e-300, 0.0]), (11, [1e300, 1e299]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert result(near_duplicates(df)) == brute_force(rows)
    assert near_duplicates(df.where("false")).count() == 0
    assert near_duplicates(df.where("vec_id in (3, 4)")).count() == 2


def test_passes():
    assert passes_for(10) == 10 or passes_for(10) >= 4
    assert passes_for(10**4) < passes_for(10**6) < passes_for(10**9) < 500


def test_common_mean_direction(spark):
    rng = np.random.default_rng(8)
    norm = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, d = 6000, 64
    rest = norm(rng.standard_normal((n, d)) * (np.arange(d) > 0))
    v = np.sqrt(0.3) * rest + np.sqrt(0.7) * np.eye(d)[0]  # a mean cosine of 0.7
    far = rest[1::2] - (rest[1::2] * rest[::2]).sum(1, keepdims=True) * rest[::2]
    v[1::2] = np.sqrt(0.3) * (0.68 * rest[::2] + np.sqrt(1 - 0.68**2) * norm(far)) + np.sqrt(0.7) * np.eye(d)[0]  # pairs at 0.904
    got = result(near_duplicates(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), window=8))
    assert np.mean([got[i][1] == got[i + 1][1] for i in range(0, n, 2)]) >= 0.99
