"""N-gram Jaccard join by token-combination prefixes.

Exact self-join of documents on their sets of word shingles at a Jaccard
threshold, down to connected components. The steps:

1. *Classes.* Documents of one set (copies) become a class, which its smallest
   doc_id stands for.
2. *Frequencies.* A token (shingle) is frequent if more than ``group`` documents
   hold it. All tokens of all documents are counted, as packed 32-bit hashes.
   The ``most_frequent`` most frequent are shipped to the tasks, a fixed bound:
   should more be frequent, the limit between rare and frequent moves up, which
   changes the order of tokens and so the work, but no result.
3. *Prefixes.* Tokens are ordered: rare ones by hash, then frequent ones by
   frequency. With t = ceil(threshold * n), two sets that link share k tokens at
   least of their first n - t + k, for every k up to t. The rare tokens of the
   first n - t + k are indexed singly, for the largest k up to ``shared_needed``
   that leaves only rare ones there, and a linked pair shares k of them (the
   smaller k of the two sets). If no k does, the set is *heavy*: all its rare
   tokens are indexed singly, and its prefix is extended to k = 2 + ceil(n / 8); a
   linked pair of heavy sets without
   a common rare token shares k frequent tokens of it, so some two of those,
   neighbours among the shared, stand at most ``REACH`` apart in both lists (the
   gaps of either list add up to its length). All combinations of two frequent
   tokens within that reach are indexed.
4. *Candidates.* Classes under one index key whose sizes allow the threshold are
   paired, for keys of up to ``group`` classes, and pairs that share fewer single
   tokens than needed are dropped. Keys with more classes are handled in two
   rounds: first every class against the key's most central one (the one with the
   fewest rare tokens). Then, after components are known, classes that keys of
   this kind connect form clusters, and clusters of several components are
   compared: by their sketches first, all with all in blocks, and only classes
   that some sketch of another component leaves in a block of two times ``CHUNK``
   classes are shipped to it with their texts, where common tokens are counted;
   no pair is written but those that join two components.
5. *Verification* on the full shingle sets, of pairs whose sketches (parities of
   hashed cells, a bound from below on what they differ in) allow it: first each
   class against its smallest partner, then the pairs that components do not join
   already.

Every pair at or above the threshold is either verified or lies inside a
component already, so components are exact; 64-bit hashes stand for shingles.

Defined cases: a document without words (or null) has an empty set and links
with nothing; one with fewer words than a shingle has one shingle, all its words;
repeated doc_ids are one document each but share their doc_id's component; rows
without a doc_id are dropped; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved, table, task_partitions
from .components import connected_components
from .shingles import mix, shingle_sets
from .tokens import release

#: Reach of token combinations; see ``reach_needed``.
REACH = 8
#: Bytes of packed tokens or postings in a bucket, which is what a task holds at a time.
BUCKET_BYTES = 16 << 20
#: Cells that ids are hashed to, where a few documents are looked for among all.
CELLS = 1 << 20
#: How many single tokens a heavy set must share: with another heavy set one, else what that one must.
_HEAVY = 65_535
_CHUNK = 512
#: Classes in a chunk of a cluster, and chunks whose sketches are compared together; every two of either meet in a task.
CHUNK, TOGETHER = 256, 8


def need(n: int, threshold: Fraction) -> int:
    """Tokens that a set of n shares at least with any set that it links to."""
    return -(-n * threshold.numerator // threshold.denominator)


def extension(n: int) -> int:
    return 2 + -(-n // 8)


def shared_needed(n: int) -> int:
    """Single tokens that a pair has to share, at most: a longer prefix for far fewer candidates."""
    return min(2 + n // 64, _HEAVY - 1)


def reach_needed(n: int, threshold: Fraction) -> float:
    """How far two neighbouring shared tokens of a heavy set of n can stand apart."""
    widest = int(n / threshold)
    k = min(extension(n), need(n, threshold))
    return 2 * (widest - need(widest, threshold) + min(extension(widest), need(widest, threshold))) / max(1, k - 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            piece = batch.slice(at, _CHUNK)
            yield piece.column(0).to_pylist(), piece.column(1).to_pylist()


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    first = int(tokens.sum(dtype=np.uint64)) if len(tokens) else 0
    second = int(np.bitwise_xor.reduce(mix(tokens + np.uint64(0x5851F42D4C957F2D)))) if len(tokens) else 0
    return first - ((first >> 63) << 64), second - ((second >> 63) << 64)


def _sketch(tokens: np.ndarray, bits: int = 10) -> np.ndarray:
    """The parity of the tokens in each of 2 ** bits cells, as words."""
    return np.packbits((np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).view(np.int64)


def _wide_sketch(tokens: np.ndarray) -> np.ndarray | None:
    """Of sets that would saturate the 1024 cells: as many cells as tokens at least."""
    return _sketch(tokens, min(18, 2 * -(-(len(tokens) - 1).bit_length() // 2))) if len(tokens) > 1024 else None


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, a 128-bit signature and sketches of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            n, a, b, sketches, wide = zip(*((len(s), *_signature(s), _sketch(s), _wide_sketch(s)) for s in shingle_sets(texts, words)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sig1", "sig2", "sketch", "wide"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, sketch array<bigint>, wide array<bigint>")


def _short(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together, bucket after bucket: a task holds one at a time."""
    return packed.repartition(min(buckets, max(task_partitions(packed.sparkSession), buckets // 4)), "bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list[bytes]]]:
    """The columns of each bucket of a partition of ``_by_bucket``."""
    release()
    now, held = None, []
    for batch in batches:
        for bucket, *rest in zip(*(batch.column(i).to_pylist() for i in range(columns + 1))):
            if bucket != now and held:
                yield list(zip(*held))
                held = []
            now = bucket
            held.append(rest)
    if held:
        yield list(zip(*held))


def _packed(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 32-bit words as the gaps between them: 16 bits each, and the wide gaps beside."""
    gaps = np.diff(tokens, prepend=tokens[:1] * 0)
    wide = gaps >= 0xFFFF
    return np.where(wide, 0xFFFF, gaps).astype(np.uint16).tobytes(), gaps[wide].astype(np.uint32).tobytes()


def _unpacked(gaps: bytes, wide: bytes) -> np.ndarray:
    out = np.frombuffer(gaps, np.uint16).astype(np.uint32)
    out[out == 0xFFFF] = np.frombuffer(wide, np.uint32)
    return np.cumsum(out, dtype=np.uint32)


def frequent_tokens(docs: DataFrame, group: int, most: int, words: int = 5, total_tokens: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the frequent tokens, sorted, and their frequencies."""
    spark = docs.sparkSession
    buckets = max(task_partitions(spark), -(-total_tokens * 5 // BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(tokens.astype(np.uint64), [(i << 32) // buckets for i in range(buckets + 1)])
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                part, m = tokens[a:b], n[a:b]
                many = m > 1
                rows.append((i, *_packed(part[~many]), *_packed(part[many]), m[many].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], names=["bucket", "once", "once_wide", "many", "many_wide", "times"])

        for _, texts in _chunks(batches):
            for s in shingle_sets(texts, words):
                held.append(_short(s))
                size += len(s)
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for once, once_wide, many, many_wide, counts in _buckets(batches, 5):
            once, many = (np.concatenate([_unpacked(a, b) for a, b in zip(*x)]) for x in ((once, once_wide), (many, many_wide)))
            counts = np.frombuffer(b"".join(counts), np.uint32)
            tokens, times = np.concatenate([once, many]), np.concatenate([np.ones(len(once), np.uint32), counts])
            order = np.argsort(tokens)
            tokens, times = tokens[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
            df = np.add.reduceat(times.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            keep = df > group
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first][keep].astype(np.int64)), pa.array(df[keep])], names=["token", "df"])

    packed = docs.mapInArrow(count, "bucket int, once binary, once_wide binary, many binary, many_wide binary, times binary")
    counted = saved(_by_bucket(packed, buckets).mapInArrow(total, "token bigint, df bigint"), "frequent")
    steps = counted.groupBy(F.floor(F.log2("df") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    held, least = 0, None
    for row in steps:  # at most 8 for each doubling
        if held + row["count"] > most:
            break
        held, least = held + row["count"], row.step
    if least is None:
        forget(counted)
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    rows = counted.where(F.floor(F.log2("df") * 8) >= least).toArrow()
    forget(counted)
    tokens, df = (np.asarray(rows.column(i).combine_chunks()) for i in (0, 1))
    order = np.argsort(tokens)
    return tokens[order].astype(np.uint32), df[order].astype(np.int64)


def _frequencies(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many documents hold each token, if it is a frequent one; else 0."""
    names, counts = frequent
    short = _short(tokens)  # tokens are sorted, so are these
    at = np.searchsorted(names, short)
    df = np.zeros(len(tokens), np.int64)
    known = at < len(names)
    known[known] = names[at[known]] == short[known]
    df[known] = counts[at[known]]
    return df


def single_keys(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: Fraction) -> tuple[np.ndarray, int]:
    """The rare tokens that index a set singly, and how many of them a linked one shares."""
    n = len(tokens)
    t = need(n, threshold)
    rare = tokens[_frequencies(tokens, frequent) == 0]
    k = min(shared_needed(n), t, len(rare) - (n - t))
    return (rare[: n - t + k], k) if k >= 1 else (rare, _HEAVY)


def combined_keys(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: Fraction) -> tuple[np.ndarray, int]:
    """The combinations of frequent tokens that index a heavy set (of others none), and its number of rare ones."""
    n = len(tokens)
    t = need(n, threshold)
    df = _frequencies(tokens, frequent)
    often = np.flatnonzero(df)
    rare = n - len(often)
    if rare >= n - t + 1:
        return np.zeros(0, np.uint64), rare
    often = often[np.lexsort((tokens[often], df[often]))][: n - t + min(extension(n), t) - rare]
    row = tokens[often]
    keys = [mix(row[:-d] * np.uint64(3) + row[d:] * np.uint64(7)) for d in range(1, min(REACH, len(row) - 1) + 1)]
    return np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)])), rare


def _postings(docs: DataFrame, shipped, threshold: Fraction, words: int, buckets: int) -> DataFrame:
    """(bucket, keys, classes, sizes, needed): packed rows of the single-token index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int, int]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([x[0] for x in held])
            lens = [len(x[0]) for x in held]
            ids, n, k = (np.repeat(np.array([x[i] for x in held], t), lens) for i, t in ((1, np.int64), (2, np.uint32), (3, np.uint16)))
            # mixed: prefixes hold small hashes, so that their high bits are uneven
            to = ((mix(keys) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [(i, *(c[o].tobytes() for c in (keys, ids, n, k))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if len(o := order[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "keys", "classes", "sizes", "needed"])

        for _, texts in _chunks(batches):
            for s in shingle_sets(texts, words):
                if len(s) and (sig := _signature(s)[0]) not in seen:  # a copy's keys go once
                    seen.add(sig)
                    keys, k = single_keys(s, shipped.value, threshold)
                    held.append((keys, sig, len(s), k))
                    size += len(keys)
            if size > 1_000_000:
                yield from flush()
                held, seen, size = [], set(), 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, keys binary, classes binary, sizes binary, needed binary")


def _allowed(n: np.ndarray, m: np.ndarray, threshold: Fraction) -> np.ndarray:
    return np.minimum(n, m) * np.int64(threshold.denominator) >= np.maximum(n, m) * np.int64(threshold.numerator)


def _runs(pairs: np.ndarray, first: np.ndarray, rows: int, most: int = 1 << 20) -> list[slice]:
    """Rows of consecutive keys, by the pairs that each key gives and its first row: about ``most`` pairs a run."""
    of = np.cumsum(pairs) // most
    cuts = [0, *first[1:][of[1:] != of[:-1]].tolist(), rows]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _pairs_of_keys(packed: DataFrame, group: int, threshold: Fraction, buckets: int) -> DataFrame:
    """(a, b, key, shared, needed): pairs of classes (a < b, key null) with the tokens
    that they share in a run of keys of a bucket, or memberships (a, size b, key) of keys too large to pair."""

    def batch(a, b, key, shared, needed) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else pa.nulls(x, pa.int64()) for x in (a, b, key, shared, needed)], names=["a", "b", "key", "shared", "needed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _buckets(batches, 4):
            keys, ids, n, k = (np.frombuffer(b"".join(c), t) for c, t in zip(own, (np.uint64, np.int64, np.uint32, np.uint16)))
            order = np.lexsort((ids, keys))
            keys, ids, n, k = keys[order], ids[order], n[order].astype(np.int64), k[order].astype(np.int64)
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
            keys, ids, n, k = keys[new], ids[new], n[new], k[new]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.concatenate([first, [len(keys)]]))
            hot = np.repeat(size, size) > group
            if hot.any():
                yield batch(ids[hot], n[hot], keys[hot].view(np.int64), int(hot.sum()), int(hot.sum()))
            for at in _runs(np.where(size > group, 0, size * (size - 1) // 2), first, len(keys)):
                i, j, shared, needed = paired(keys[at], ids[at], n[at], k[at], hot[at])
                if len(i):
                    yield batch(ids[at][i], ids[at][j], len(i), shared, needed)

    def paired(keys, ids, n, k, hot) -> tuple[np.ndarray, ...]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([first, [len(keys)]]))
        found = [np.zeros((2, 0), np.int64)]
        place = np.arange(len(keys)) - np.repeat(first, size)
        left = np.repeat(size, size) - 1 - place  # rows of the key after this one
        left[hot] = 0
        for d in range(1, int(left.max(initial=0)) + 1):
            i = np.flatnonzero(left >= d)
            i = i[_allowed(n[i], n[i + d], threshold)]
            found.append(np.stack([i, i + d]))
        i, j = np.concatenate(found, axis=1)
        order = np.lexsort((ids[j], ids[i]))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.concatenate([[True], (ids[i][1:] != ids[i][:-1]) | (ids[j][1:] != ids[j][:-1])])) if len(i) else i
        shared, i, j = np.diff(np.concatenate([new, [len(i)]])), i[new], j[new]
        return i, j, shared.astype(np.int64), np.where((k[i] == _HEAVY) & (k[j] == _HEAVY), 1, np.minimum(k[i], k[j]))

    return _by_bucket(packed, buckets).mapInArrow(run, "a bigint, b bigint, key bigint, shared bigint, needed bigint")


def _combinations(docs: DataFrame, shipped, threshold: Fraction, words: int) -> DataFrame:
    """(key, a, n, rare): the combination index of heavy sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches):
            rows: dict[int, tuple[np.ndarray, int, int]] = {}
            for s in shingle_sets(texts, words):
                keys, rare = combined_keys(s, shipped.value, threshold)
                if len(keys):
                    rows[_signature(s)[0]] = keys, len(s), rare
            if rows:
                lens = [len(r[0]) for r in rows.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([r[0] for r in rows.values()]).view(np.int64)), *(pa.array(np.repeat(np.array(c, np.int64), lens)) for c in (list(rows), [r[1] for r in rows.values()], [r[2] for r in rows.values()]))],
                    names=["key", "a", "n", "rare"],
                )

    return docs.mapInArrow(run, "key bigint, a bigint, n bigint, rare bigint").distinct()


def _cell(c: str):
    return F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(CELLS)).cast("int")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is among ``ids`` (doc_id, distinct).

    As in ``_texts_of``, only documents in a cell that holds such an id are shuffled;
    all others, and rows without a doc_id, are passed on where they are read.
    """
    cell = "_" + max(docs.columns, key=len)  # no column's name
    marked = docs.withColumn(cell, _cell("doc_id"))
    cells = F.broadcast(ids.select(_cell("doc_id").alias(cell)).distinct())
    near = marked.join(cells, cell, "left_semi").join(ids, "doc_id", "left_anti")
    return marked.join(cells, cell, "left_anti").select(docs.columns).unionByName(near.select(docs.columns))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents with these ids, one of each.

    Texts are not shuffled to find the few: a document's id is hashed to one of
    ``CELLS`` cells, and the cells that hold a wanted id, no more than that many
    numbers at any size, are broadcast to drop nearly all others where they are read.
    """
    cell = _cell("id").alias("cell")
    near = docs.toDF("id", "text").select("id", "text", cell).join(F.broadcast(ids.select(cell).distinct()), "cell", "left_semi")
    return near.select("id", "text").join(ids, "id").dropDuplicates(["id"])


def _verified(docs: DataFrame, pairs: DataFrame, threshold: Fraction, words: int) -> DataFrame:
    """Of ``pairs`` (u, v: doc_ids) those whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                one, two = (shingle_sets(piece.column(i).to_pylist(), words) for i in (2, 3))
                keep = []
                for s, t in zip(one, two):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(threshold.denominator * common >= threshold.numerator * (len(s) + len(t) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(mask), piece.column(1).filter(mask)], names=["u", "v"])

    ends = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = saved(_texts_of(docs, ends), "texts")
    rows = pairs.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v")
    out = saved(rows.select("u", "v", "text_u", "text_v").mapInArrow(run, "u bigint, v bigint"), "links")
    forget(texts)
    return out


def _links(docs: DataFrame, pairs: DataFrame, threshold: Fraction, words: int) -> DataFrame:
    """Verified pairs, enough for the components of all that reach the threshold: each
    class against its smallest partner, then what lies between different components."""
    nearest = pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    first = _verified(docs, nearest, threshold, words)
    known = connected_components(first).toDF("id", "component")
    rest = pairs.join(nearest, ["u", "v"], "left_anti")
    rest = rest.join(known.toDF("u", "cu"), "u", "left").join(known.toDF("v", "cv"), "v", "left")
    second = _verified(docs, saved(rest.where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v"), "rest"), threshold, words)
    return first.unionByName(second)


def _joined_in_cluster(key, part):
    """Links between components of two chunks of a cluster: enough to join what is joined."""
    import pandas as pd

    threshold, words = Fraction(int(part["num"].iloc[0]), int(part["den"].iloc[0])), int(part["words"].iloc[0])
    part = part.sort_values("id")
    ids, chunk, component = (part[c].to_numpy() for c in ("id", "chunk", "component"))
    sets = list(shingle_sets(part["text"].tolist(), words))
    n = np.array([len(s) for s in sets], np.int64)
    tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    size = np.diff(np.concatenate([first, [len(tokens)]]))
    common = np.zeros((len(sets), len(sets)), np.int64)
    wide = np.flatnonzero(size >= 16)
    for a in range(0, len(wide), 2048):  # tokens of many sets: as products of bit matrices
        held = np.zeros((len(sets), min(2048, len(wide) - a)), np.float32)
        for j, w in enumerate(wide[a : a + 2048]):
            held[row[first[w] : first[w] + size[w]], j] = 1
        common += (held @ held.T).astype(np.int64)
    few, of = size < 16, np.repeat(np.arange(len(size)), size)
    for d in range(1, 15):  # tokens of few sets: their pairs
        at = np.flatnonzero((of[:-d] == of[d:]) & few[of[:-d]])
        np.add.at(common, (row[at], row[at + d]), 1)
        np.add.at(common, (row[at + d], row[at]), 1)
    hit = threshold.denominator * common >= threshold.numerator * (n[:, None] + n[None, :] - common)
    hit &= component[:, None] != component[None, :]
    if key[1] != key[2]:
        hit &= chunk[:, None] != chunk[None, :]
    i, j = np.nonzero(np.triu(hit, 1))
    u, v = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
    pairs = np.unique(np.stack([u, v], 1), axis=0)  # components are named by a member each
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches of the same sets with fewer cells: neighbouring cells become one."""
    bits = np.unpackbits(sketch.view(np.uint8), axis=1)
    return np.packbits(bits.reshape(len(sketch), 64 * words, -1).sum(axis=2, dtype=np.uint16).astype(np.uint8) & 1, axis=1).view(np.int64)


def _may_link(sketch: np.ndarray, n: np.ndarray, component: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which two sets of different components are not too far apart by their sizes and sketches."""
    up, down = threshold.numerator + threshold.denominator, threshold.denominator - threshold.numerator
    out = np.zeros((len(n), len(n)), bool)
    step = max(1, (1 << 21) // max(1, sketch.size))
    sketch = sketch.view(np.uint64)  # of signed words the bits of the absolute value would be counted
    for a in range(0, len(n), step):
        i = slice(a, a + step)
        ok = (component[i, None] != component[None, :]) & _allowed(n[i, None], n[None, :], threshold)
        apart = np.bitwise_count(sketch[i, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
        out[i] = ok & (apart * up <= (n[i, None] + n[None, :]) * down)
    return out


def _near_in_cluster(key, part):
    """(a, b, id): who has to meet in which two chunks, of all in two groups of chunks of a cluster."""
    import pandas as pd

    threshold = Fraction(int(part["num"].iloc[0]), int(part["den"].iloc[0]))
    ids, chunk, component, n = (part[c].to_numpy() for c in ("id", "chunk", "component", "n"))
    may = _may_link(np.stack(part["sketch"].to_numpy()), n, component, threshold)
    if key[1] != key[2]:
        group = chunk // TOGETHER
        may &= group[:, None] != group[None, :]
    wide = part["wide"].to_numpy()
    large = np.flatnonzero([w is not None for w in wide])
    words = np.array([len(wide[x]) for x in large], np.int64)
    for size in np.unique(words):  # of two sets of more than 1024 tokens, cells of the smaller one
        at = large[words >= size]
        cells = np.concatenate([_folded(wide[x][None, :], int(size)) for x in at])
        pairs = np.ix_(at, at)
        smaller = np.minimum(words[words >= size][:, None], words[words >= size][None, :]) == size
        may[pairs] &= ~smaller | _may_link(cells, n[at], component[at], threshold)
    i, j = np.nonzero(may)
    rows = np.unique(np.stack([np.minimum(chunk[i], chunk[j]), np.maximum(chunk[i], chunk[j]), i], 1), axis=0)
    return pd.DataFrame({"cluster": np.full(len(rows), key[0], np.int64), "a": rows[:, 0], "b": rows[:, 1], "id": ids[rows[:, 2]]})


def _meetings(chunk: str, chunks: str):
    """Every chunk with each, itself included, the lower one first."""
    return F.transform(F.sequence(F.lit(0), F.col(chunks) - 1), lambda c: F.struct(F.least(chunk, c).alias("a"), F.greatest(chunk, c).alias("b")))


def _cluster_links(docs: DataFrame, hot: DataFrame, classes: DataFrame, near: DataFrame, threshold: Fraction, words: int) -> DataFrame:
    """(u, v): links that join components of classes under keys too large to pair."""
    ids = classes.select("sig1", "class_id")
    named = hot.select(F.col("a").alias("sig1"), F.col("first").alias("sig2")).distinct().join(ids, "sig1").join(ids.toDF("sig2", "first_id"), "sig2")
    edges = named.select(F.col("class_id").alias("u"), F.col("first_id").alias("v"))
    cluster = connected_components(edges).toDF("id", "cluster")
    member = cluster.join(near.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = member.groupBy("cluster").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    member = member.join(mixed.select("cluster", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")), "cluster")
    member = saved(member.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")), "members")
    fixed = [F.lit(x).alias(c) for c, x in (("num", threshold.numerator), ("den", threshold.denominator), ("words", words))]
    grouped = member.withColumns({"group": F.floor(F.col("chunk") / TOGETHER).cast("int"), "groups": F.ceil(F.col("chunks") / TOGETHER).cast("int")})
    sketched = grouped.join(classes.select(F.col("class_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "wide"), "id")
    sketched = sketched.select("cluster", F.explode(_meetings("group", "groups")).alias("meet"), "chunk", "id", "component", "n", "sketch", "wide")
    close = sketched.select("cluster", "meet.a", "meet.b", "chunk", "id", "component", "n", "sketch", "wide", *fixed).groupBy("cluster", "a", "b").applyInPandas(_near_in_cluster, "cluster bigint, a int, b int, id bigint")
    close = saved(close, "close")
    texts = saved(_texts_of(docs, close.select("id").distinct()), "texts")
    dealt = close.join(member.select("cluster", "id", "chunk", "component"), ["cluster", "id"]).join(texts, "id")
    out = saved(dealt.select("cluster", "a", "b", "chunk", "id", "component", "text", *fixed).groupBy("cluster", "a", "b").applyInPandas(_joined_in_cluster, "u bigint, v bigint"), "links")
    forget(member, close, texts)
    return out


def jaccard_join(docs: DataFrame, threshold: Fraction = Fraction(4, 5), words: int = 5, group: int = 32, most_frequent: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, copies, kept for ``docs`` (doc_id, text).

    ``copies`` counts the documents of the same set; ``kept`` marks the first
    document of each component, and documents with an empty set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prints = saved(fingerprints(docs, words), "prints")
    sets = F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"), F.any_value("wide").alias("wide")
    classes = saved(prints.where("n_shingles > 0").groupBy("n_shingles", "sig1", "sig2").agg(*sets), "classes")
    tokens = prints.agg(F.sum("n_shingles")).first()[0] or 0

    shipped = spark.sparkContext.broadcast(frequent_tokens(docs, group, most_frequent, words, tokens))
    buckets = max(task_partitions(spark), -(-tokens * 6 // BUCKET_BYTES))
    singles = saved(_pairs_of_keys(_postings(docs, shipped, threshold, words, buckets), group, threshold, buckets), "pairs")
    index = saved(_combinations(docs, shipped, threshold, words), "combinations")
    sizes = saved(index.groupBy("key").agg(F.count("*").alias("size"), F.min_by("a", F.struct("rare", "n", "a")).alias("first")).where("size > 1"), "keys")
    small = index.join(sizes.where(F.col("size") <= group).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("own")).select("own").distinct()
    ratio = f"least(x.n, y.n) * {threshold.denominator}L >= greatest(x.n, y.n) * {threshold.numerator}L"
    paired = small.select(F.explode("own").alias("x"), "own").select("x", F.explode("own").alias("y")).where("x.a < y.a").where(ratio).selectExpr("x.a as a", "y.a as b")
    hot = index.join(sizes.where(F.col("size") > group), "key").select("key", "a", "n", "first")
    large = singles.where("key is not null").select("key", "a", F.col("b").alias("n"))  # only if the limit of frequent tokens moved
    hot = hot.unionByName(large.join(large.groupBy("key").agg(F.min("a").alias("first")), "key").select("key", "a", "n", "first"))
    hot = saved(hot, "hot")
    alone = singles.where("key is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed")).where("shared >= needed").select("a", "b")
    pairs = alone.unionByName(paired).unionByName(hot.where("a <> first").select(F.least("a", "first").alias("a"), F.greatest("a", "first").alias("b"))).distinct()

    first = saved(_named(pairs, classes, threshold), "candidates")
    forget(singles, index, sizes)
    edges = _links(docs, first, threshold, words)
    if not hot.isEmpty():
        edges = edges.unionByName(_cluster_links(docs, hot, classes, connected_components(edges), threshold, words))
    forget(hot, first)
    labels = connected_components(edges)
    out = prints.drop("sketch", "wide").join(classes.drop("sketch", "wide"), ["n_shingles", "sig1", "sig2"], "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    result = saved(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), (component == F.col("doc_id")).alias("kept")), "components")
    forget(prints, classes)
    return result


def _named(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of signatures as pairs of class ids, the smaller one first.

    Left out: pairs whose sketches show that they differ in too many tokens. A
    sketch has the parity of the tokens in each of its cells, so two sets differ
    in as many tokens at least as their sketches in bits. Only pairs that the small
    sketches leave, of sets that are large both, meet the wide ones.
    """

    def apart(one: str, two: str) -> str:
        bits = f"aggregate(zip_with({one}, {two}, (x, y) -> bit_count(x ^ y)), 0, (n, c) -> n + c)"
        return f"{bits} * {threshold.numerator + threshold.denominator}L > (n_1 + n_2) * {threshold.denominator - threshold.numerator}L"

    def side(sig: str, i: int, sketch: str) -> DataFrame:
        return classes.select(F.col("sig1").alias(sig), F.col("class_id").alias(f"id_{i}"), F.col("n_shingles").alias(f"n_{i}"), F.col(sketch).alias(f"s_{i}"))

    named = pairs.join(side("a", 1, "sketch"), "a").join(side("b", 2, "sketch"), "b").where("id_1 <> id_2")
    near = saved(named.where(f"not {apart('s_1', 's_2')}").select("a", "b", "id_1", "id_2", "n_1", "n_2"), "near")
    large = near.where("n_1 > 1024 and n_2 > 1024").select("a", "b")
    wide = large.join(side("a", 1, "wide"), "a").join(side("b", 2, "wide"), "b")
    bad = wide.where(f"size(s_1) = size(s_2) and {apart('s_1', 's_2')}").select("id_1", "id_2")
    near = near.join(bad, ["id_1", "id_2"], "left_anti")
    return near.select(F.least("id_1", "id_2").alias("u"), F.greatest("id_1", "id_2").alias("v")).distinct()


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: five-word shingles, Jaccard of 0.8 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"))
