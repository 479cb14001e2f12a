"""Token-ID / binary output: token ids as Parquet list columns.

Layout of a token file, one row per document in ascending ``doc_id`` order:

=============  ==============  ==========================================
doc_id         BIGINT          delta encoding
part           INT             the file's place in the order
part_start     BIGINT          delta encoding; ids before it in its part
n_tokens       INT             delta encoding; with the end id
ids            ARRAY<INT>      dictionary encoding
=============  ==============  ==========================================

Row groups, pages and page row counts are bounded, and the writer leaves column
and offset indexes, so that a reader of a few documents skips the other pages,
and one that wants only lengths never touches the ids.

Defined cases: null and empty texts hold just the end id; rows that repeat a
doc_id all stay, ordered by their text; a null doc_id comes first; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table
from .tokens import ID, TOGETHER, default_vocabulary, shared_encoder

ENCODED = "doc_id bigint, part int, part_start bigint, n_tokens int, ids array<int>"
DIGEST = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Rows in global doc_id order, each with its ids and its start in its part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = shared_encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], ID).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                ids = [x + end for x in encoder.encode_many(piece.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                before = start + np.cumsum(n) - n
                start += int(n.sum())
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, ENCODED)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 2,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> str:
    """Encode ``docs`` (doc_id, text) and write the token file below ``path``."""
    writer = encode_documents(docs, vocabulary or default_vocabulary(), end_id).write
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
    } | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part_start", "n_tokens")}
    writer.options(**options).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token file with each document's global ``start``."""
    stored = spark.read.schema(ENCODED).parquet(path)
    sums = sorted((r.part, r.n) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, before = [], 0
    for part, n in sums:  # one row for each file
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part int, part_base bigint")
    return stored.join(F.broadcast(bases), "part").withColumn("start", F.col("part_base") + F.col("part_start")).drop("part_base")


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as unsigned 32-bit words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            words = memoryview(np.asarray(lists.values).astype(ID)).cast("B")
            at = np.asarray(lists.offsets).astype(np.int64)
            crc = [zlib.crc32(words[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as a token file in the shared folder and read back."""
    path = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    return token_digest(read_tokens(spark, path))
