"""When prices go stale: every change of an offer's freshness, at the moment it is due.

An offer that is observed is fresh; without a new observation it is ageing after
half its service level, stale after all of it, expired after three times. On a
stream a timer an offer fires when the watermark passes the next change, also
while nothing new of the offer arrives; observations out of order within the
watermark count as if they had come in order. A table is replayed to the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The parts of a service level after which a price changes, and to what.
STAGES = ((0.5, "AGEING"), (1.0, "STALE"), (3.0, "EXPIRED"))
_STATE = "spans string, done int"
_HOUR = 3_600_000_000  # microseconds


class Clock:
    """What is known of one offer: spans of observations with no change inside, in order, and how many changes of the first are told."""

    def __init__(self, sla_hours: float, spans: list[tuple[int, int]], done: int):
        self.after = [int(part * sla_hours * _HOUR) for part, _ in STAGES]
        self.spans, self.done = spans, done

    def observe(self, times: list[int]) -> None:
        merged: list[list[int]] = []
        for a, b in sorted(self.spans + [(t, t) for t in times]):
            if merged and a - merged[-1][1] <= self.after[0]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.spans = [(a, b) for a, b in merged]

    def advance(self, now: int) -> list[tuple[int, str, int]]:
        """(seen, state, due) of all changes due before ``now`` that were not told yet."""
        out: list[tuple[int, str, int]] = []
        while self.spans:
            seen = self.spans[0][1]
            following = self.spans[1][0] if len(self.spans) > 1 else None
            while self.done < len(STAGES):
                due = seen + self.after[self.done]
                if due >= now or following is not None and due >= following:
                    break
                out.append((seen, STAGES[self.done][1], due))
                self.done += 1
            if following is None or following >= now:
                break
            self.spans, self.done = self.spans[1:], 0  # nothing older than ``now`` can come between
        return out

    def next_due(self) -> int | None:
        """When the next change is due, if nothing new is observed."""
        for i, (_, seen) in enumerate(self.spans):
            done = self.done if i == 0 else 0
            following = self.spans[i + 1][0] if i + 1 < len(self.spans) else None
            if done < len(STAGES) and (following is None or seen + self.after[done] < following):
                return seen + self.after[done]
        return None


def _spans(text: str) -> list[tuple[int, int]]:
    return [tuple(map(int, s.split(":"))) for s in text.split(",") if s]


def staleness_changes(rows: DataFrame, key: str, at: str, sla_hours: str, late: str = "6 hours", until: str | None = None) -> DataFrame:
    """(key, seen, state, due): the changes of each offer of ``rows`` (key, at, sla_hours).

    On a table those due before ``until`` (all, if none is given). Rows without a
    key or a time are left out; repeated ones change nothing; an offer that is
    observed under several service levels has the changes of each.
    """
    seen = rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(sla_hours).cast("double").alias("sla")).where("key is not null and at is not null and sla is not null")
    return _streamed(seen, late) if rows.isStreaming else _replayed(seen, until)


def _replayed(seen: DataFrame, until: str | None) -> DataFrame:
    """The next observation of each: within a cell of time by a window, across cells from the cells' first ones,
    so that an offer of very many observations is sorted by as many tasks as it has cells."""
    times = seen.select("key", "sla", F.unix_micros("at").alias("t")).withColumn("cell", F.expr(f"t div {30 * 24 * _HOUR}"))
    within = times.withColumn("next", F.lead("t").over(Window.partitionBy("key", "sla", "cell").orderBy("t")))
    cells = times.groupBy("key", "sla", "cell").agg(F.min("t").alias("first"))
    cells = cells.select("key", "sla", "cell", F.lead("first").over(Window.partitionBy("key", "sla").orderBy("cell")).alias("later"))
    stages = F.array(*(F.struct(F.lit(s).alias("state"), (F.col("t") + F.floor(F.lit(p) * F.col("sla") * _HOUR)).cast("bigint").alias("due")) for p, s in STAGES))
    ahead = within.join(cells, ["key", "sla", "cell"]).withColumn("next", F.coalesce("next", "later"))
    told = ahead.select("key", "t", "next", F.explode(stages).alias("s")).where("next is null or s.due < next")
    if until is not None:
        told = told.where(F.col("s.due") < F.unix_micros(F.lit(until).cast("timestamp")))
    return told.select("key", F.timestamp_micros("t").alias("seen"), F.col("s.state").alias("state"), F.timestamp_micros("s.due").alias("due"))


def _streamed(seen: DataFrame, late: str) -> DataFrame:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, sla = key
        spans, done = state.get if state.exists else ("", 0)
        clock = Clock(sla, _spans(spans), done)
        for part in parts:
            clock.observe((part["at"].astype("datetime64[us]").astype("int64")).tolist())
        now = state.getCurrentWatermarkMs() * 1000
        told = clock.advance(now)
        due = clock.next_due()
        if due is None:  # expired: a new observation starts afresh
            state.remove()
        else:
            state.update((",".join(f"{a}:{b}" for a, b in clock.spans), clock.done))
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        if told:
            moments = lambda i: pd.to_datetime([x[i] for x in told], unit="us")
            yield pd.DataFrame({"key": name, "seen": moments(0), "state": [x[1] for x in told], "due": moments(2)})

    watched = seen.withWatermark("at", late)
    return watched.groupBy("key", "sla").applyInPandasWithState(step, "key string, seen timestamp, state string, due timestamp", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
