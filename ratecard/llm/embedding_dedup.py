"""Embedding near-dedup by sorted projection passes.

In every pass each vector gets a key of concatenated random hashes, the signs of
its products with random directions (which agree for two vectors at an angle a
with probability 1 - a / pi each). Vectors are sorted by (pass, key), and each is
compared with the ``window`` vectors after it; pairs whose cosine reaches the
threshold in double precision are links, and their union over all passes gives
components. Besides, vectors that share the first ``depth_for`` signs of a key, a
prefix group, are all compared with each other: within a block as they stand, and
groups wider than the window that cross blocks in bounded blocks of their own. So
a pair at the threshold meets in a pass with at least the probability that those
signs agree, however the vectors lie, and the number of passes follows from that:
the pair is missed with a probability of at most ``miss``. Crowded vectors (a common
mean direction, a loose cluster) cost comparisons, not links. Of what a block finds
only a spanning forest is written out.

The sorted order is cut into blocks of bounded size by global rank, each with the
``window`` rows before it. Equal vectors are one node with a weight from the start.

*Completion.* A window misses links of clusters wider than itself. So after the
passes every component is compared with itself in bounded blocks, and each
vector's links are counted there: within components nothing is missed, and no
pair is written out.

Defined cases: vectors that are null, zero, or hold null or non-finite components
link with nothing and stand for themselves; vectors of different lengths do not
link; of a repeated vec_id the least vector (in the order of arrays) is compared,
and every row is returned; rows without a vec_id are dropped; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, task_partitions
from .components import connected_components

THRESHOLD = 0.9
WINDOW = 64
MISS = 0.005
BLOCK = 512
CROWD = 2048


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with probability ``miss`` at most.

    Two vectors meet in a pass if they agree in the first log2(n / window) signs.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(2, n) / window))
    return max(4, math.ceil(math.log(miss) / math.log1p(-agree)))


def depth_for(n: int, window: int = WINDOW) -> int:
    """The number of signs of a prefix group, no more than ``passes_for`` reckons with."""
    return min(62, int(max(1.0, math.log2(max(2, n) / window))))


def forest(similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place that is connected in the symmetric ``similar``, and the first place of its part."""
    linked = np.flatnonzero(similar.any(axis=1))
    similar = similar[np.ix_(linked, linked)]
    root = np.full(len(linked), -1)
    for seed in range(len(linked)):
        if root[seed] < 0:
            root[seed], edge = seed, np.array([seed])
            while len(edge):
                edge = np.flatnonzero(similar[edge].any(axis=0) & (root < 0))
                root[edge] = seed
    own = np.flatnonzero(root != np.arange(len(root)))
    return linked[root[own]], linked[own]


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): one array of finite numbers, not all zero, for each id."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("v")).where("id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of the vectors that have it, and their matrix."""
    flat, at = np.asarray(column.values), np.asarray(column.offsets)
    lengths = np.diff(at)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[at[rows][:, None] + np.arange(n)]


def _keys(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """(p, key, id, v): every vector in every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                ids = np.asarray(piece.column("id"))
                for places, m in matrices(pa.concat_arrays([piece.column("v")])):
                    d = m.shape[1]
                    if d not in directions:
                        directions[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * 62))
                    signs = (unit(m) @ directions[d] > 0).reshape(len(m), passes, 62)
                    keys = (signs * (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64))).sum(axis=2)
                    order = np.tile(np.arange(len(m)), passes)
                    values = pa.array(m[order].ravel())  # as they came: floats stay floats
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.arange(passes, dtype=np.int32), len(m))),
                            pa.array(keys.T.ravel()),
                            pa.array(ids[places][order]),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * np.int32(d)), values),
                        ],
                        names=["p", "key", "id", "v"],
                    )

    return rows.mapInArrow(run, f"p int, key bigint, id bigint, v {rows.schema['v'].dataType.simpleString()}")


def window_links(rows: DataFrame, n: int, threshold: float, window: int, miss: float, seed: int) -> DataFrame:
    """(u, v): pairs of ids found in some window of some pass."""
    spark = rows.sparkSession
    passes = passes_for(n, threshold, window, miss)
    parts = max(task_partitions(spark), math.ceil(n * passes / 200_000))
    ordered = _keys(rows, passes, seed).repartitionByRange(parts, "p", "key", "id").sortWithinPartitions("p", "key", "id")
    prefix = F.shiftright("key", 62 - depth_for(n, window)).alias("prefix")
    ordered = saved(ordered.select(F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("place"), "p", prefix, "id", "v"), "sorted")
    counts = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    base, before = [], 0
    for part, size in counts:
        base.append((part, before))
        before += size
    ranked = ordered.join(F.broadcast(spark.createDataFrame(base, "part int, base bigint")), "part").withColumn("rank", F.col("base") + F.col("place"))
    block = (F.col("rank") / BLOCK).cast("bigint")
    late = F.col("rank") % BLOCK >= BLOCK - window  # also wanted before the next block
    dealt = ranked.select(F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"), "rank", "p", "prefix", "id", "v")

    def found(part, close) -> pd.DataFrame:
        ids, lengths = part["id"].to_numpy(), part["v"].map(len).to_numpy()
        pairs = []
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            m = unit(np.stack(part["v"].to_numpy()[at]))
            similar = (m @ m.T >= threshold) & close[np.ix_(at, at)]
            np.fill_diagonal(similar, False)
            i, j = forest(similar)
            pairs.append(np.stack([ids[at[i]], ids[at[j]]], 1))
        pairs = np.sort(np.concatenate(pairs), axis=1)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    def same(part) -> np.ndarray:
        p, prefix = part["p"].to_numpy(), part["prefix"].to_numpy()
        return (p[:, None] == p) & (prefix[:, None] == prefix)

    def compare(part):
        part = part.sort_values("rank")
        rank, p = part["rank"].to_numpy(), part["p"].to_numpy()
        return found(part, (p[:, None] == p) & (np.abs(rank[:, None] - rank) <= window) | same(part))

    near = dealt.groupBy("block").applyInPandas(compare, "u bigint, v bigint")
    # groups wider than the window and in several blocks: every two chunks of a group meet once
    groups = ranked.groupBy("p", "prefix").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    wide = groups.where((F.col("high") - F.col("low") > window) & (F.floor(F.col("low") / BLOCK) < F.floor(F.col("high") / BLOCK)))
    chunk = F.floor(F.col("rank") / CROWD)
    others = F.explode(F.sequence(F.floor(F.col("low") / CROWD), F.floor(F.col("high") / CROWD))).alias("other")
    crowd = ranked.join(wide, ["p", "prefix"]).select(chunk.alias("chunk"), others, "p", "prefix", "id", "v")
    crowd = crowd.select(F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "p", "prefix", "id", "v")
    exact = crowd.groupBy("a", "b").applyInPandas(lambda part: found(part, same(part)), "u bigint, v bigint")
    return near.unionByName(exact).distinct()


def component_links(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): for each of ``nodes`` (id, v, weight) the weight of what it links
    with in its component, counted in bounded blocks."""
    member = nodes.join(labels.toDF("id", "component"), "id")
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    member = member.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # every two chunks meet once, in a group of their own
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("chunk", c).alias("a"), F.greatest("chunk", c).alias("b")))
    dealt = member.select("component", F.explode(meets).alias("meet"), "chunk", "id", "v", "weight").select("component", "meet.a", "meet.b", "chunk", "id", "v", "weight")

    def compare(key, part):
        ids, chunk, weight = (part[c].to_numpy() for c in ("id", "chunk", "weight"))
        lengths = part["v"].map(len).to_numpy()
        linked = np.zeros(len(part), np.int64)
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            m = unit(np.stack(part["v"].to_numpy()[at]))
            similar = (m @ m.T >= threshold) & ~np.eye(len(at), dtype=bool)
            if key[1] != key[2]:
                similar &= chunk[at][:, None] != chunk[at][None, :]
            linked[at] = similar @ weight[at]
        return pd.DataFrame({"id": ids, "linked": linked})[linked > 0]

    counted = dealt.groupBy("component", "a", "b").applyInPandas(compare, "id bigint, linked bigint")
    return counted.groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) for every id of ``vectors``."""
    if window >= BLOCK:
        raise ValueError(f"the window must be under {BLOCK}")
    rows = usable(vectors, id_column, column)
    nodes = saved(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "nodes")
    links = saved(window_links(nodes.select("id", "v"), nodes.count(), threshold, window, miss, seed), "links")
    labels = connected_components(links)
    counted = component_links(nodes, labels, threshold)
    known = nodes.join(labels.toDF("id", "component"), "id", "left").join(counted, "id", "left")
    known = known.select("v", F.coalesce("component", "id").alias("component"), (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    found = rows.join(known, "v").select("id", "component", "n_links")
    ids = vectors.select(F.col(id_column).cast("bigint").alias("id")).where("id is not null")
    out = ids.join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` at a cosine of 0.9, whatever their labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
