"""Streams: trending queries, windows, sessions, latest-by-key, and a token bucket.

The windows are extensions over the events table; the token bucket and the
latest-by-key upsert are stateful operators of the engine itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A client's tokens, and how many come back in a second.
CAPACITY, REFILL = 8.0, 0.5
BUCKET = "user_id bigint, event_id bigint, ts timestamp, allowed boolean, tokens_milli bigint"
_STATE = "tokens double, at double"


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and value of each type and window; the watermark matters on a stream only."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("value_minor")).select(F.col("w.start").alias("start"), "event_type", "n", "value_minor")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _spend(rows: pd.DataFrame, tokens: float, at: float | None) -> tuple[pd.DataFrame, float, float | None]:
    """Serve requests in order of time: a token each, refilled by the time that passed."""
    rows = rows.sort_values(["ts", "event_id"])
    seconds = (rows["ts"] - pd.Timestamp(0)) / pd.Timedelta(seconds=1)
    allowed, left = [], []
    for t in seconds:
        if at is not None:
            tokens = min(CAPACITY, tokens + max(0.0, t - at) * REFILL)
        at = t if at is None else max(at, t)
        allowed.append(tokens >= 1)
        tokens -= 1 if tokens >= 1 else 0
        left.append(int(tokens * 1000 + 0.5))
    out = rows[["user_id", "event_id", "ts"]].assign(allowed=allowed, tokens_milli=left)
    return out, tokens, at


def token_bucket(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Which requests of each client are served. On a stream the bucket is kept in
    the state store; on a table each client's requests are replayed in order."""
    rows = events.select("user_id", "event_id", "ts")
    if not events.isStreaming:
        return rows.groupBy("user_id").applyInPandas(lambda part: _spend(part, CAPACITY, None)[0], BUCKET)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # a full bucket needs no memory
            state.remove()
            return
        tokens, at = state.get if state.exists else (CAPACITY, None)
        out, tokens, at = _spend(pd.concat(list(parts)), tokens, at)
        state.update((tokens, float(at)))
        full_again = int((at + CAPACITY / REFILL) * 1000) + 1
        state.setTimeoutTimestamp(max(full_again, state.getCurrentWatermarkMs() + 1))  # a deadline must lie ahead
        yield out

    return rows.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, BUCKET, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batch(batch: DataFrame, n: int, path: str, keys: list[str], at: str, *ties: str) -> None:
    """Version n of a table: the newest row of each key of the version before n and the batch.

    A batch that is run again starts from the same earlier version, so it gives the same table.
    """
    from ..operators.reports import latest_per_key
    from ..sources.sinks import publish, read_version, versions

    earlier = [v for v in versions(batch.sparkSession, path) if v < f"{n:08d}"]
    rows = read_version(batch.sparkSession, path, max(earlier)).unionByName(batch) if earlier else batch
    publish(latest_per_key(rows, keys, at, *ties), path, f"{n:08d}")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], at: str, checkpoint: str, *ties: str):
    """Keep the newest row of each key in a versioned table; exact repeats change nothing."""
    return stream.writeStream.foreachBatch(lambda batch, n: upsert_batch(batch, n, path, keys, at, *ties)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trending_stream(log: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, q, n, latest) of every window: how often each query that found something was asked."""
    rows = log.where("hits > 0").select(F.lower(F.trim("q")).alias("q"), "at")
    rows = rows.withWatermark("at", late) if log.isStreaming else rows
    return rows.groupBy(F.window("at", width).alias("w"), "q").agg(F.count("*").alias("n"), F.max("at").alias("latest")).select(F.col("w.start").alias("start"), "q", "n", "latest")


def observe_stream(stream: DataFrame, path: str, checkpoint: str, trigger: str = "stream"):
    """Append every batch to the observation ledger as a run of its own; a batch that is run again replaces its run."""

    def append(batch: DataFrame, n: int) -> None:
        batch.withColumns({"trigger": F.lit(trigger)}).write.mode("overwrite").parquet(f"{path}/run_id={n:08d}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
