"""Packing: hierarchical multi-length packing of documents into sequences.

Every document is a list of ids with an end id. Its whole windows of the
longest tier become sequences of their own; what is left over is routed to the
smallest tier that holds it. Tiers are packed from the longest down: each
leftover opens a window, the window's gap takes the largest pieces of shorter
tiers that fit, and a last piece is cut to close it. Sequences therefore end
full, at a power of two. Within a group of documents, sequences of a tier are
dealt to step groups of equally many tokens, in serpentine order of their
attention cost, so that the steps' costs are balanced.

Groups are bounded (``group_tokens``) and packed where they are read: nothing is
shuffled, and a lost task is packed again alike. What does not fill a sequence
is carried to the next group of the task; only a task's last sequence is padded.

Defined cases: null and empty texts hold just the end id; repeated rows are
packed each; a document longer than a window is cut; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import ID, TOGETHER, default_vocabulary, shared_encoder

TIERS = (256, 512, 1024, 2048)
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int, sequence_tokens int, padded_to int, step_group bigint"
)


class _Rest:
    """Leftover stretches, by length: (length, document, start)."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []

    def add(self, length: int, doc: int, start: int) -> None:
        if length:
            insort(self.items, (length, doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest stretch of at most ``most``, if any."""
        at = bisect_right(self.items, (most, 1 << 62, 1 << 62))
        return self.items.pop(at - 1) if at else None


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Pack documents of these lengths.

    Returns the sequences as (tier, [(document, start, length), ...]), and the
    (document, start, length) that filled no sequence; with ``last`` those make
    a final short sequence and none is returned.
    """
    widest, rest, sequences = tiers[-1], _Rest(), []
    for doc, n in enumerate(lengths):
        whole = n - n % widest
        sequences += [(widest, [(doc, at, widest)]) for at in range(0, whole, widest)]
        rest.add(n - whole, doc, whole)
    total = sum(x[0] for x in rest.items)
    for tier in reversed(tiers):
        shorter = max((t for t in tiers if t < tier), default=0)
        while total >= tier and rest.items and (rest.items[-1][0] > shorter or tier == tiers[0]):
            parts, gap = [], tier
            while gap:
                got = rest.take(gap)
                if got is None:  # nothing fits: cut the shortest there is
                    length, doc, start = rest.items.pop(0)
                    rest.add(length - gap, doc, start + gap)
                    got = (gap, doc, start)
                parts.append((got[1], got[2], got[0]))
                gap -= got[0]
            sequences.append((tier, parts))
            total -= tier
    over = [(doc, start, length) for length, doc, start in reversed(rest.items)]
    if not last:
        return sequences, over
    while over:
        parts, room = [], widest
        while over and room:
            doc, start, length = over.pop(0)
            if length > room:
                over.insert(0, (doc, start + room, length - room))
                length = room
            parts.append((doc, start, length))
            room -= length
        sequences.append((widest, parts))
    return sequences, []


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A step for each sequence: equally many tokens, cost dealt in serpentine order."""
    steps, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}):
        own = [i for i, (t, _) in enumerate(sequences) if t == tier]
        own.sort(key=lambda i: (-sum(n * n for _, _, n in sequences[i][1]), i))
        count = max(1, -(-len(own) * tier // step_tokens))
        for place, i in enumerate(own):
            turn, at = divmod(place, count)
            steps[i] = first + (at if turn % 2 == 0 else count - 1 - at)
        first += count
    return steps


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 20, step_tokens: int = 1 << 15) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text); see ``PIECES``."""
    vocabulary = vocabulary or default_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = shared_encoder(vocabulary), np.array([end_id], ID).tobytes()
        base = TaskContext.get().partitionId() << 36
        made, steps, held = 0, 0, []  # held: (doc_id, ids from here on, ids before, all ids)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, steps, held
            sequences, over = pack_lengths([len(x[1]) // 4 for x in held], tiers, last)
            groups = step_groups(sequences, step_tokens)
            rows = []
            for (tier, parts), group in zip(sequences, groups):
                size, offset = sum(p[2] for p in parts), 0
                for doc, start, length in parts:
                    doc_id, ids, before, total = held[doc]
                    rows.append((doc_id, before + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, base + made, offset, tier, size, size if size & (size - 1) == 0 else tiers[-1], base + steps + group))
                    offset += length
                made += 1
            steps += 1 + max(groups, default=-1)
            held = [(held[doc][0], held[doc][1][4 * start : 4 * (start + length)], held[doc][2] + start, held[doc][3]) for doc, start, length in over]
            if rows:
                kinds = [pa.int64()] * 7 + [pa.int32()] * 3 + [pa.int64()]
                names = [c.split()[0] for c in PIECES.split(", ")]
                for at in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 20_000]), kinds)], names=names)

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode_many(piece.column("text").to_pylist())):
                    held.append((doc_id, ids + end, 0, len(ids) // 4 + 1))
                    waiting += len(ids) // 4 + 1
                    if waiting >= group_tokens:
                        yield from flush(last=False)
                        waiting = 0
        yield from flush(last=True)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
