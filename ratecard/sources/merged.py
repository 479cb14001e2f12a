"""Keyed tables that are merged when they are read.

=====================================  ==============================================
``changes/batch=N/bucket=B``           rows of batch N, dealt to buckets by a hash of the key
``compacted/upto=N/bucket=B``          newest row of each key of a bucket, of batches up to N
``_batches/N``, ``_compacted/B-N``     empty files: what may be read
``_buckets/n``                         empty file: the number of buckets
=====================================  ==============================================

A batch writes its own rows and nothing else. Reading takes each bucket's last
compaction and the batches after it, and keeps the newest row of each key.
Compaction rewrites the buckets that have batches to merge, no others. A batch or
a compaction that is run again writes the same folder again; one that broke off
is not read, since its empty file comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import latest_per_key
from .sinks import _files

BUCKET = "_bucket"


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _mark(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.create(p, True).close()


def create(spark: SparkSession, root: str, buckets: int) -> None:
    """A table of so many buckets: about as many as files of the whole table should be."""
    if _names(spark, f"{root}/_buckets"):
        raise ValueError(f"{root} is there already")
    _mark(spark, f"{root}/_buckets/{buckets}")


def write_changes(batch: DataFrame, n: int, root: str, keys: list[str]) -> None:
    """Add batch ``n``: one small file for each bucket it touches."""
    spark = batch.sparkSession
    buckets = int(_names(spark, f"{root}/_buckets")[0])
    rows = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    rows.repartition(BUCKET).write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{root}/changes/batch={n:08d}")
    _mark(spark, f"{root}/_batches/{n:08d}")


def _compactions(spark: SparkSession, root: str) -> dict[int, int]:
    """Each bucket's last compaction."""
    out: dict[int, int] = {}
    for name in _names(spark, f"{root}/_compacted"):
        bucket, upto = map(int, name.split("-"))
        out[bucket] = max(upto, out.get(bucket, -1))
    return out


def _parts(spark: SparkSession, root: str) -> tuple[dict[int, str], dict[int, list[tuple[int, str]]]]:
    """Of each bucket: its last compaction's folder, and (batch, folder) of the changes after it."""
    done = _compactions(spark, root)
    base = {b: f"{root}/compacted/upto={n:08d}/{BUCKET}={b}" for b, n in done.items()}
    later: dict[int, list[tuple[int, str]]] = {}
    for name in _names(spark, f"{root}/_batches"):
        for folder in _names(spark, f"{root}/changes/batch={name}"):
            if folder.startswith(f"{BUCKET}="):
                bucket = int(folder.split("=")[1])
                if int(name) > done.get(bucket, -1):
                    later.setdefault(bucket, []).append((int(name), f"{root}/changes/batch={name}/{folder}"))
    return base, later


def read_merged(spark: SparkSession, root: str, schema, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The newest row of each key; ``schema``: the rows' own."""
    base, later = _parts(spark, root)
    paths = [*base.values(), *(p for parts in later.values() for _, p in parts)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return latest_per_key(rows, keys, at, *ties)


def compact(spark: SparkSession, root: str, schema, keys: list[str], at: str, *ties: str, least: int = 1) -> list[int]:
    """Merge the buckets that have at least ``least`` batches since their last compaction; which these were."""
    base, later = _parts(spark, root)
    touched = sorted(b for b, parts in later.items() if len(parts) >= least)
    if not touched:
        return []
    upto = max(n for b in touched for n, _ in later[b])
    paths = [p for b in touched for p in ([base[b]] if b in base else []) + [p for _, p in later[b]]]
    buckets = int(_names(spark, f"{root}/_buckets")[0])
    rows = latest_per_key(spark.read.schema(schema).parquet(*paths), keys, at, *ties)
    rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # a bucket's folder is replaced whole, and the folders of other buckets of an earlier, equal ``upto`` stay
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{root}/compacted/upto={upto:08d}")
    for b in touched:
        _mark(spark, f"{root}/_compacted/{b}-{upto}")
    return touched


def vacuum(spark: SparkSession, root: str) -> None:
    """Remove what no reader of the table as it is now opens."""
    done = _compactions(spark, root)
    for name in _names(spark, f"{root}/_batches"):
        for folder in _names(spark, f"{root}/changes/batch={name}"):
            if folder.startswith(f"{BUCKET}=") and int(name) <= done.get(int(folder.split("=")[1]), -1):
                fs, p = _files(spark, f"{root}/changes/batch={name}/{folder}")
                fs.delete(p, True)
    for name in _names(spark, f"{root}/compacted"):
        for folder in _names(spark, f"{root}/compacted/{name}"):
            if folder.startswith(f"{BUCKET}=") and int(name.split("=")[1]) < done.get(int(folder.split("=")[1]), -1):
                fs, p = _files(spark, f"{root}/compacted/{name}/{folder}")
                fs.delete(p, True)


def merge_stream(stream: DataFrame, root: str, keys: list[str], checkpoint: str):
    """Add every batch of a stream as changes; compaction is a job of its own."""
    return stream.writeStream.foreachBatch(lambda batch, n: write_changes(batch, n, root, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
