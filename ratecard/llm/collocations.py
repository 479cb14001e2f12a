"""Phrase collocation mining by depth-limited count tries.

Every task (shard) counts words, pairs and triples of its texts in tries of
depth three, one a language. A trie is held as sorted arrays: its nodes are the
word sequences in order, packed into one integer each while it is counted. Of
every ``SHARD_TOKENS`` tokens one trie is serialised, sorted and cut by prefix
range: the nodes below a two-word prefix go to the range that the prefix hashes
to. A range's runs from all shards meet in one task, are merged (a stable sort
of sorted runs under one order of words) and summed.

A walk down the merged trie gives the left part of a triple, its two-word
ancestor, for nothing; other left parts are the roots' children. The right part
of a phrase is where its suffix link points, the same phrase without its first
word, which lies in another range: links are equi-joins on the words. Only nodes
of at least ``least`` occurrences leave the merge: parts of a candidate occur at
least as often as it does, so none that is needed is missed.

Memory: a shard's trie holds at most ``SHARD_TOKENS`` new tokens, whatever the
texts (a long piece is continued with its last two words); a range holds what
``RANGE_CHARS`` characters give on average, since the number of ranges follows
from the characters of all texts. Texts are not split by language or key, so a
hot source or language is dealt evenly.

Defined cases: null and empty texts have no words; a null lang is ``und``, and
one with the rows that say so; repeated rows count each; ties of a cut go to the
shortest left part, ties of ranks to the phrase, whose UTF-8 bytes decide;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, task_partitions

#: Characters that end a piece (each stands for itself in what ``_TOKEN`` finds), and words.
ENDS = ".,;:!?\n\x0b\x0c\r"
_TOKEN = re.compile(f"[{ENDS}]|[^ \t{ENDS}]+")
_BREAK = re.compile(f"[ \t{ENDS}]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
UNKNOWN = "und"
#: Tokens of one trie, and characters of all texts a range of prefixes.
SHARD_TOKENS, RANGE_CHARS = 1_000_000, 6_000_000
#: Characters of a text that are split at a time.
BLOCK = 4_000_000
#: Phrases of 2 to 3 words from ``LEAST`` occurrences on; dropped from ``COVERED`` percent within one longer; ``TOP`` a language.
LEAST, COVERED, TOP = 10, 50, 2_000
SCALE = 1_000_000
_BITS = 21  # of a word's place within a trie
RUNS = "lang string, range int, words binary, nodes binary, counts binary"
MERGED = "lang string, w1 string, w2 string, w3 string, a bigint, before bigint"


def tokens_of(text: str) -> Iterator[list[str]]:
    """Words and piece ends of a text in order, those of ``BLOCK`` characters or so at a time."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    at = 0
    while at < len(low):
        cut = _BREAK.search(low, at + BLOCK)
        to = cut.start() if cut else len(low)
        yield _TOKEN.findall(low, at, to)
        at = to


class Shard:
    """Tries of a task: words as ids by first appearance, sequences as arrays of ids."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.held = 0
        self.ids: dict[str, defaultdict] = {}
        self.rows: dict[str, list[np.ndarray]] = {}
        self.known: dict[str, int] = {}  # leading tokens that an earlier trie has counted

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        last: list[str] = []
        for block in tokens_of(text):
            at, tokens = len(last), last + block
            while at < len(tokens):
                if lang not in self.ids:  # a piece may go on: its last two words are its context
                    self._open(lang, tokens[max(at - 2, 0) : at])
                part = tokens[at : at + max(SHARD_TOKENS - self.held, 1)]
                self.rows[lang].append(np.fromiter(map(self.ids[lang].__getitem__, part), np.int32, len(part)))
                at, self.held = at + len(part), self.held + len(part)
                if self.held >= SHARD_TOKENS:
                    yield from self.flush()
            last = tokens[-2:]
        if lang in self.rows:
            self.rows[lang].append(np.zeros(1, np.int32))  # a text ends a piece

    def _open(self, lang: str, context: list[str]) -> None:
        ids = self.ids[lang] = defaultdict()
        ids.default_factory = ids.__len__
        for end in ENDS:
            ids[end]
        self.rows[lang] = [np.fromiter(map(ids.__getitem__, context), np.int32, len(context))]
        self.known[lang] = len(context)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.ids):
            yield from trie_runs(lang, self.ids[lang], np.concatenate(self.rows[lang]), self.known[lang], self.ranges)
        self.ids, self.rows, self.known, self.held = {}, {}, {}, 0


def trie_runs(lang: str, ids: dict[str, int], row: np.ndarray, known: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The trie of a row of ids (of which ends are below ``len(ENDS)``), cut by prefix range."""
    ends = len(ENDS)
    names = sorted(w for w, i in ids.items() if i >= ends)
    place = np.zeros(len(ids), np.int64)  # 0: an end; else one more than its place in order
    for i, w in enumerate(names, 1):
        place[ids[w]] = i
    row = place[row]
    is_word = row > 0
    one = row[known:][is_word[known:]]
    pairs = np.flatnonzero(is_word[1:] & is_word[:-1])
    pairs = pairs[pairs + 1 >= known]
    triples = np.flatnonzero(is_word[2:] & is_word[1:-1] & is_word[:-2]) if len(row) > 2 else pairs[:0]
    triples = triples[triples + 2 >= known]
    node = np.concatenate([one << 2 * _BITS, (row[pairs] << 2 * _BITS) | (row[pairs + 1] << _BITS), (row[triples] << 2 * _BITS) | (row[triples + 1] << _BITS) | row[triples + 2]])
    node, counts = np.unique(node, return_counts=True)
    crc = np.array([0] + [zlib.crc32(w.encode()) for w in names], np.uint64)
    w1, w2 = node >> 2 * _BITS, (node >> _BITS) & ((1 << _BITS) - 1)
    mixed = (crc[w1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((crc[w2] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    part = ((mixed >> np.uint64(20)) % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(part, kind="stable")  # nodes stay sorted within a range
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for run in np.split(order, cuts) if len(order) else []:
        yield _run(lang, int(part[run[0]]), names, node[run], counts[run])
    if len(one):  # the root's count
        yield _run(lang, -1, [], np.zeros(1, np.int64), np.array([len(one)]))


def _run(lang: str, at: int, names: list[str], node: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    mask = (1 << _BITS) - 1
    columns = np.stack([node >> 2 * _BITS, (node >> _BITS) & mask, node & mask])
    used = np.unique(columns)
    own = np.searchsorted(used, columns).astype(np.int32) + (0 if len(used) and used[0] == 0 else 1)
    words = " ".join(names[i - 1] for i in used.tolist() if i).encode()
    packed = zlib.compress(own.tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at], pa.int32()), pa.array([zlib.compress(words, 1)]), pa.array([packed]), pa.array([zlib.compress(counts.astype(np.int64).tobytes(), 1)])], names=["lang", "range", "words", "nodes", "counts"])


def merge_runs(runs: list[tuple[bytes, bytes, bytes]], least: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one range merged: (words, node columns, counts, count of a triple's two-word ancestor), all of ``least`` on."""
    read = [zlib.decompress(w).decode() for w, _, _ in runs]
    lists = [w.split(" ") if w else [] for w in read]
    names = sorted(set().union(*lists))
    place = {w: i for i, w in enumerate(names, 1)}
    columns, counts = [], []
    for own, (_, nodes, n) in zip(lists, runs):
        to = np.fromiter([0, *map(place.__getitem__, own)], np.int64, len(own) + 1)
        columns.append(to[np.frombuffer(zlib.decompress(nodes), np.int32).reshape(3, -1)])
        counts.append(np.frombuffer(zlib.decompress(n), np.int64))
    columns, counts = np.concatenate(columns, axis=1), np.concatenate(counts)
    if len(names) < 1 << _BITS:
        order = np.argsort((columns[0] << 2 * _BITS) | (columns[1] << _BITS) | columns[2], kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    columns, counts = columns[:, order], counts[order]
    new = np.append(True, np.any(columns[:, 1:] != columns[:, :-1], axis=0))
    columns, counts = columns[:, new], np.add.reduceat(counts, np.flatnonzero(new))
    # in trie order a triple's ancestor is the last node of two words before it
    pair = (columns[1] > 0) & (columns[2] == 0)
    last = np.maximum.accumulate(np.where(pair, np.arange(len(counts)), 0))
    before = np.where(columns[2] > 0, counts[last], 0)
    kept = counts >= least
    return names, columns[:, kept], counts[kept], before[kept]


def shard_tries(docs: DataFrame, ranges: int) -> DataFrame:
    """Serialised runs of the tries of ``docs`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(ranges)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                yield from shard.add(lang, text.as_py())
        yield from shard.flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, RUNS)


def merged_tries(runs: DataFrame, least: int) -> DataFrame:
    """Nodes of at least ``least`` occurrences; ``before``: of a triple, the count of its first two words. The roots have no word."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for lang, at, *run in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, at) != key:
                    if held:
                        yield _merged(key, held, least)
                    key, held = (lang, at), []
                held.append(tuple(run))
        if held:
            yield _merged(key, held, least)

    parts = task_partitions(runs.sparkSession)
    return runs.repartition(parts, "lang", "range").sortWithinPartitions("lang", "range").mapInArrow(merge, MERGED)


def _merged(key: tuple[str, int], runs: list[tuple[bytes, bytes, bytes]], least: int) -> pa.RecordBatch:
    lang, at = key
    names, columns, counts, before = merge_runs(runs, least if at >= 0 else 1)
    words = pa.array([None, *names], pa.string())
    take = lambda c: words.take(pa.array(c))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), *map(take, columns), pa.array(counts), pa.array(before)], names=["lang", "w1", "w2", "w3", "a", "before"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``MERGED`` of ``docs`` (lang, text), written to the shared folder."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    ranges = max(task_partitions(docs.sparkSession), -(-chars // RANGE_CHARS))
    return saved(merged_tries(shard_tries(docs, ranges), least), "tries")


def scored_candidates(nodes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of all phrases of two and three words, with the most a longer candidate holding it has."""
    one = nodes.where("w1 is not null and w2 is null").select("lang", F.col("w1").alias("w"), F.col("a").alias("f"))
    pair = nodes.where("w2 is not null and w3 is null")
    triple = nodes.where("w3 is not null")
    first, last = one.toDF("lang", "w1", "f1"), one.toDF("lang", "w", "fw")
    linked = pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    ends = lambda df, word: df.join(first, ["lang", "w1"]).join(last.withColumnRenamed("w", word), ["lang", word])
    score = lambda left, right: F.expr(f"(cast({SCALE} * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")
    of_two = ends(pair, "w2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "w1", "w2", "a", F.col("f1").alias("l"), F.col("fw").alias("r"), score("f1", "fw").alias("score"))
    cuts = ends(triple, "w3").join(linked, ["lang", "w2", "w3"]).withColumns({"s1": score("f1", "f23"), "s2": score("before", "fw")})
    early = F.col("s1") <= F.col("s2")
    either = lambda a, b: F.when(early, F.col(a)).otherwise(F.col(b))
    of_three = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", either("f1", "before").alias("l"), either("f23", "fw").alias("r"), either("s1", "s2").alias("score"))
    within = triple.select("lang", "w1", "w2", "a").unionAll(triple.select("lang", "w2", "w3", "a")).toDF("lang", "w1", "w2", "a")
    within = within.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    of_two = of_two.join(within, ["lang", "w1", "w2"], "left").drop("w1", "w2")
    return of_two.unionByName(of_three, allowMissingColumns=True)


def mine_collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations a language of ``docs`` (lang, text)."""
    nodes = phrase_counts(docs, least)
    whole = nodes.where("w1 is null").select("lang", F.col("a").alias("n"))
    kept = scored_candidates(nodes).where(f"longer is null or 100 * longer < {covered} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are among the best of its parts, so no task ranks all of a language
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all ``documents``."""
    return mine_collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
with d as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, row_number() over () as id, piece from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
w as (select lang, id, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) as w, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) as i from p),
g as (select lang, w as w1, lead(w, 1) over piece as w2, lead(w, 2) over piece as w3 from w window piece as (partition by id order by i)),
k as (select lang, [w1] as g from g union all select lang, [w1, w2] from g where w2 is not null union all select lang, [w1, w2, w3] from g where w3 is not null),
f as (select lang, array_to_string(g, ' ') as p, any_value(g) as g, count(*) as a from k group by lang, p),
n as (select lang, sum(a) as n from f where len(g) = 1 group by lang),
c as (select lang, p, g, a from f where len(g) >= 2 and a >= {LEAST}),
ways as (select lang, p, g, a, k, array_to_string(g[1:k], ' ') as x, array_to_string(g[k + 1:], ' ') as y from (select *, unnest(range(1, len(g))) as k from c)),
cut as (select ways.lang, ways.p, ways.g, ways.a, k, x.a as l, y.a as r, ({SCALE}::hugeint * ways.a * ways.a) // (x.a::hugeint * y.a) as score
  from ways join f x on x.lang = ways.lang and x.p = ways.x join f y on y.lang = ways.lang and y.p = ways.y),
best as (select * from cut qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (select lang, s, max(a) as most from (select lang, a, array_to_string(unnest([g[1:2], g[2:3]]), ' ') as s from c where len(g) = 3) group by all),
kept as (select best.* from best left join longer on longer.lang = best.lang and longer.s = best.p where most is null or 100 * most < {COVERED} * best.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, p)::bigint as rank, p as phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept join n on n.lang = kept.lang qualify rank <= {TOP}
"""
