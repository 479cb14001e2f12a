"""Staleness: the stream's timers against a replay, and the clock against plain loops."""

import random

from pyspark.sql import functions as F

from ratecard.streaming.staleness import STAGES, Clock, staleness_changes
from tests.conftest import SF


def plain(times, sla_hours, until):
    times = sorted(set(times))
    out = []
    for t, following in zip(times, [*times[1:], None]):
        for part, state in STAGES:
            due = t + int(part * sla_hours * 3_600_000_000)
            if due < until and (following is None or due < following):
                out.append((t, state, due))
    return sorted(out)


def test_clock_in_any_order():
    rng = random.Random(3)
    hour = 3_600_000_000
    for _ in range(300):
        sla, late = rng.choice((1, 4)), 6 * hour
        times = sorted(rng.randrange(200) * hour // 2 for _ in range(rng.randrange(1, 15)))
        arrivals = sorted(times, key=lambda t: t + rng.randrange(late))  # none later than the watermark allows
        clock, told, now, newest = Clock(sla, [], 0), [], 0, 0
        for t in arrivals:
            assert t >= now
            clock.observe([t])
            newest = max(newest, t)
            if rng.random() < 0.7:
                now = max(now, newest - late)
                told += clock.advance(now)
                due = clock.next_due()
                assert due is None or due >= now
        told += clock.advance(10**15)
        assert sorted(told) == plain(times, sla, 10**15) and clock.next_due() is None


def test_stream_equals_replay(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("sla", F.lit(12)).select("user_id", "ts", "sla")
    rows = sorted(events.collect(), key=lambda r: r.ts)
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r.ts.timestamp() + rng.randrange(5 * 3600))  # up to five hours late
    n = len(order) // 4
    for i in range(4):
        part = order[i * n :] if i == 3 else order[i * n : (i + 1) * n]
        late = [(-1, rows[0].ts, 12)] if i == 3 else []  # far behind the watermark: too late to count
        spark.createDataFrame([tuple(r) for r in part] + late, events.schema).coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    q = staleness_changes(stream, "user_id", "ts", "sla").writeStream.format("memory").queryName("stale").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    watermark = max(p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in p["eventTime"])
    got = sorted(tuple(r) for r in spark.table("stale").collect())
    want = sorted(tuple(r) for r in staleness_changes(events, "user_id", "ts", "sla", until=watermark.replace("T", " ").rstrip("Z")).collect())
    assert got == want and len(got) > 100 and {r[2] for r in got} == {"AGEING", "STALE", "EXPIRED"}
    last = max(rows, key=lambda r: r.ts).ts
    assert any(r[3] < last for r in got)


def test_odd_rows(spark):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:30:00", 1), (None, "2024-01-01 00:00:00", 1), ("b", None, 1), ("c", "2024-03-01 00:00:00", None), ("a", "2024-05-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "k string, t string, s int").withColumn("t", F.col("t").cast("timestamp"))
    got = sorted((str(r.seen), r.state, str(r.due)) for r in staleness_changes(df, "k", "t", "s").collect())
    first = [("2024-01-01 00:30:00", s, d) for s, d in (("AGEING", "2024-01-01 01:00:00"), ("EXPIRED", "2024-01-01 03:30:00"), ("STALE", "2024-01-01 01:30:00"))]
    assert got[:3] == first and len(got) == 6  # observed again just when it was due: no change
    assert staleness_changes(df.limit(0), "k", "t", "s").count() == 0
