"""Tables merged on reading: replays, compaction of touched buckets, and what a batch writes."""

import random
from pathlib import Path

from ratecard.sources import merged

SCHEMA = "k int, at timestamp, v int, note string"
KEYS = ["k"]


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def rows_of(spark, root):
    return sorted((r.k, r.v) for r in merged.read_merged(spark, root, SCHEMA, KEYS, "at", "v").collect())


def test_merge_on_read(spark, tmp_path):
    import datetime

    rng = random.Random(2)
    day = datetime.datetime(2024, 1, 1)
    make = lambda keys: [(k, day + datetime.timedelta(hours=rng.randrange(500)), rng.randrange(1000), "x" * 40) for k in keys]
    batches = [make(range(3000)), make(rng.sample(range(3000), 40)), make([7, 7, 8]), make(rng.sample(range(4000), 60))]
    root = str(tmp_path / "t")
    merged.create(spark, root, 8)
    assert rows_of(spark, root) == []
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    latest = {}
    for n, rows in enumerate(batches):
        merged.write_changes(frame(rows), n, root, KEYS)
        for r in rows:
            latest[r[0]] = max(latest.get(r[0], r), r, key=lambda x: (x[1], x[2]))
        assert rows_of(spark, root) == sorted((k, r[2]) for k, r in latest.items())
        if n == 0:
            whole = size(tmp_path)
            assert merged.compact(spark, root, SCHEMA, KEYS, "at", "v") == list(range(8))
        if n == 2:
            before = size(tmp_path)
            touched = merged.compact(spark, root, SCHEMA, KEYS, "at", "v", least=2)
            assert touched and len(touched) <= 2  # two keys alone are in both batches
            assert size(tmp_path) - before < whole / 2
            assert merged.compact(spark, root, SCHEMA, KEYS, "at", "v", least=2) == []
            assert rows_of(spark, root) == sorted((k, r[2]) for k, r in latest.items())
    assert max(size(f"{root}/changes/batch={n:08d}") for n in (1, 2, 3)) < size(f"{root}/changes/batch=00000000")
    merged.write_changes(frame(batches[1]), 1, root, KEYS)  # run again
    want = sorted((k, r[2]) for k, r in latest.items())
    assert rows_of(spark, root) == want
    frame([(1, day + datetime.timedelta(days=99), 5, "")]).write.parquet(f"{root}/changes/batch=00000009/{merged.BUCKET}=0")
    assert rows_of(spark, root) == want  # broke off before it was published
    merged.compact(spark, root, SCHEMA, KEYS, "at", "v")
    merged.vacuum(spark, root)
    assert rows_of(spark, root) == want


def test_stream_into_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-02", 2), (2, "2024-01-01", 3)], "k int, t string, v int").selectExpr("k", "cast(t as timestamp) as at", "v", "'n' as note")
    rows.write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "t")
    merged.create(spark, root, 4)
    merged.merge_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), root, KEYS, str(tmp_path / "c")).awaitTermination(120)
    assert rows_of(spark, root) == [(1, 2), (2, 3)]
