"""Queries of stateful operators and incremental tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import merged
from ..sources.scratch import shared_path
from ..streaming.staleness import staleness_changes
from .catalogue import query
from .offers import table

_UNTIL = "2024-01-31 00:00:00"


@query("staleness_changes", f"""with e as (select distinct user_id, ts, case when user_id % 2 = 0 then 12 else 24 end as sla from events),
n as (select *, lead(ts) over (partition by user_id order by ts) as following from e),
s as (select user_id, ts as seen, following, state, ts + to_milliseconds((part * sla * 3600000)::bigint) as due from n cross join (values (0.5, 'AGEING'), (1.0, 'STALE'), (3.0, 'EXPIRED')) as v(part, state))
select user_id::varchar as key, seen, state, due from s where (following is null or due < following) and due < timestamp '{_UNTIL}'""")
def staleness_changes_(spark, sf_dir):
    """When what each user was last seen with goes stale: users stand for offers, with service levels of 12 and 24 hours."""
    seen = table(spark, sf_dir, "events").withColumn("sla", F.when(F.col("user_id") % 2 == 0, 12).otherwise(24))
    return staleness_changes(seen, "user_id", "ts", "sla", until=_UNTIL)


@query("merged_upserts", """select user_id, event_id, ts, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def merged_upserts(spark, sf_dir):
    """The latest event of each user, after batches in no order of time, one of them twice, and a compaction in between."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    root = shared_path(spark, "merged")
    merged.create(spark, root, 16)
    for n in (0, 1, 2, 1, 3):
        merged.write_changes(rows.where(F.col("event_id") % 4 == n), n, root, ["user_id"])
        if n == 2:
            merged.compact(spark, root, rows.schema, ["user_id"], "ts", "event_id")
    return merged.read_merged(spark, root, rows.schema, ["user_id"], "ts", "event_id")
