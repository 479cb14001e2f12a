"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some stretch of it is within the
item's edit budget. Both are compared lower-cased, with runs of white space as
one space. An item of n characters has a budget of ``floor(rate * n)`` edits and
is split into budget + 1 pieces: a stretch within the budget leaves at least one
piece untouched. An Aho-Corasick automaton finds every exact piece hit; a hit is
checked up the tree of halvings that made the pieces (a node with k edits has
children with k_l + k_r = k - 1, so one of them is within its own budget), and
last against the whole item, with Myers' bit-parallel distance on the text
around the hit. Most chance hits end one level up, at a few characters.

The test items go to the tasks in blocks of at most ``block_chars`` characters;
the documents are read once for each block, however many items there are.

Items shorter than ``least_chars`` after normalisation have the same budget, and
match whole words only: the stretch begins and ends where a letter or digit has no
other beside it outside, so that a short item is not found inside longer words.

Defined cases: items that are null or empty after normalisation match nothing;
documents that are null or empty are clean; whole texts are searched; a repeated
item or document is treated each time; an empty benchmark or corpus gives no
matches; further columns are ignored by ``contamination`` and kept by
``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import release

RATE = 0.1
LEAST_CHARS = 24
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: dict[str, int], size: int, text: str, most: int) -> int:
    """Smallest edit distance of the pattern to any stretch of ``text``, or most + 1.

    ``pattern``: for each character the bits of its places in the pattern.
    """
    ones = (1 << size) - 1
    top = 1 << (size - 1)
    up, down, now, best = ones, 0, size, min(size, most + 1)
    get = pattern.get
    for c in text:
        eq = get(c, 0)
        x = eq | down
        flat = ((((x & up) + up) ^ up) | x) & ones
        right, left = (down | ~(flat | up)) & ones, up & flat
        if right & top:
            now += 1
        elif left & top:
            now -= 1
        right = (right << 1) & ones
        left = (left << 1) & ones
        up = (left | ~(flat | right)) & ones
        down = right & flat
        if now < best:
            best = now
            if not best:
                break
    return best


def words_distance(item: str, text: str, origin: int, most: int) -> int:
    """Smallest edit distance of ``item`` to a stretch of whole words that begins near ``origin``, or most + 1."""
    apart = lambda i: not (text[max(0, i - 1) : i].isalnum() and text[i : i + 1].isalnum())
    best = most + 1
    for start in range(max(0, origin - most), min(len(text), origin + most) + 1):
        if not apart(start):
            continue
        row = list(range(len(item) + 1))  # of the stretch so far to each beginning of the item
        for end in range(start, min(len(text), start + len(item) + most)):
            c, last, row[0] = text[end], row[0], row[0] + 1
            for j, x in enumerate(item, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != c))
            if row[-1] < best and apart(end + 1):
                best = row[-1]
    return best


@dataclass
class Node:
    """A stretch of an item and the edits it may have."""

    item: int
    start: int
    text: str
    edits: int
    parent: int  # -1: the whole item

    def bits(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(self.text):
            out[c] = out.get(c, 0) | (1 << i)
        return out


def split_item(item: int, text: str, budget: int, nodes: list[Node]) -> None:
    """Append the item's tree of halvings; its leaves are its budget + 1 pieces."""
    todo = [(0, len(text), budget, -1)]
    while todo:
        start, end, edits, parent = todo.pop()
        nodes.append(Node(item, start, text[start:end], edits, parent))
        if edits:
            left = edits // 2
            right = edits - 1 - left
            middle = start + (end - start) * (left + 1) // (left + right + 2)
            todo += [(middle, end, right, len(nodes) - 1), (start, middle, left, len(nodes) - 1)]


class Matcher:
    """The items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int = 0):
        import ahocorasick

        self.items = items
        self.short = [len(text) < least_chars for _, text in items]
        self.budgets = [int(rate * len(text)) for _, text in items]
        self.nodes: list[Node] = []
        for i, (_, text) in enumerate(items):
            split_item(i, text, self.budgets[i], self.nodes)
        leaves: dict[str, list[int]] = {}
        for i, node in enumerate(self.nodes):
            if not node.edits:
                leaves.setdefault(node.text, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for text, own in leaves.items():
            self.automaton.add_word(text, (len(text), own))
        self.automaton.make_automaton()
        self.patterns: dict[int, dict[str, int]] = {}

    def _within(self, at: int, text: str, origin: int) -> int:
        """Distance of the node, if the item would start at ``origin`` of the text."""
        node = self.nodes[at]
        slack = node.edits  # an untouched piece below has moved no further
        window = text[max(0, origin + node.start - slack) : max(0, origin + node.start + len(node.text) + slack)]
        pattern = self.patterns.get(at)
        if pattern is None:
            pattern = self.patterns[at] = node.bits()
        return myers(pattern, len(node.text), window, node.edits)

    def search(self, text: str) -> dict[int, int]:
        """Item (place in ``items``) -> its distance, for each one within its budget."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, leaves) in self.automaton.iter(text):
            for leaf in leaves:
                node = self.nodes[leaf]
                if found.get(node.item) == 0:
                    continue
                origin = end - size + 1 - node.start
                at, ok = leaf, True
                while ok and self.nodes[at].parent >= 0:
                    at = self.nodes[at].parent
                    if (at, origin) in tried:
                        ok = False
                        break
                    tried.add((at, origin))
                    if self.short[node.item] and self.nodes[at].parent < 0:
                        break  # judged below, by whole words
                    distance = self._within(at, text, origin)
                    ok = distance <= self.nodes[at].edits
                if ok and self.short[node.item]:
                    distance = words_distance(self.items[node.item][1], text, origin, self.budgets[node.item])
                    ok = distance <= self.budgets[node.item]
                if ok:
                    if at == leaf and not self.short[node.item]:  # an item without a budget
                        distance = 0
                    found[node.item] = min(distance, found.get(node.item, distance))
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items to match, normalised, in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget): every document with every item that it holds within the budget."""
    schema = "doc_id bigint, item_id bigint, distance int, budget int"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate, least_chars)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    for i, distance in matcher.search(normal(text.as_py())).items():
                        rows.append((doc_id, matcher.items[i][0], distance, matcher.budgets[i]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "distance", "budget"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a test item within its budget; nothing is shuffled."""
    for block in _blocks(benchmark, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            release()
            matcher = Matcher(shipped.value, rate, least_chars)
            for batch in batches:
                clean = [not matcher.search(normal(text.as_py())) for text in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
