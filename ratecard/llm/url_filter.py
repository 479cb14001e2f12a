"""URL filters by a temporal list join, in DataFrame operations only.

A list is a table of dated entries: a key (a host with all below it, or a host
and the start of a path), what happens to it (``block``, ``allow`` or
``remove``) and since when. The last entry of a key before the next one is what
holds, so entries become validity intervals ``[since, until)`` by ``lead`` over
each key. Every capture is turned into the keys that could name it, its host and
all parent domains and the starts of its path, and joined by key to the intervals
that contain its fetch time. The most specific active key decides: longer keys
first, ``allow`` before ``block`` on equal keys; none: ``pass``.

The join is on a key, with the time as a further condition: no side is broadcast
unless Spark's own size check says so. Every capture sends its top-level domain, so
a key can be in most of them: keys are dealt to ``SALTS`` parts by the capture, and
the far fewer intervals go to each part; after that the join is a plain one of two
shuffles, which adaptive execution can split further.
Captures carry only their ids, keys and times into the shuffle.

Defined cases: a URL that is null or has no host is ``invalid``; a capture
without a fetch time matches nothing (``pass``); entries without key, action or
date are ignored; of entries of one key and date, ``remove`` wins over ``allow``
over ``block``; repeated captures are decided each; empty lists pass everything;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
SALTS = 16
_RANK = "case action when 'remove' then 3 when 'allow' then 2 when 'block' then 1 end"


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and a final dot; null if there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), r"\.+$", ""))
    return F.when(host != "", host)


def url_keys(url: Column) -> Column:
    """Distinct keys that can name a URL: domains, and the host with path starts of whole segments."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda p: p != "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>"))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of ``entries`` (key, action, since); until is null while it holds."""
    usable = entries.select(F.lower("key").alias("key"), F.lower("action").alias("action"), F.col("since").cast("timestamp").alias("since")).where(f"key is not null and since is not null and {_RANK} is not null")
    one = usable.groupBy("key", "since").agg(F.max_by("action", F.expr(_RANK)).alias("action"))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return one.withColumn("until", until).where("action <> 'remove'").select("key", "action", "since", "until")


def filter_captures(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, host, fetched, decision, matched_key, since) for each of ``captures`` (id, url, fetched)."""
    rows = captures.select(F.col(id_column).alias("id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("timestamp").alias("fetched"))
    part = F.pmod(F.xxhash64("id", "url", "fetched"), F.lit(SALTS)).cast("int").alias("part")
    probes = rows.select("id", "url", "fetched", part, F.explode(F.when(host_of(F.col("url")).isNotNull(), url_keys(F.col("url")))).alias("key"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("list_part")
    lists = validity_intervals(entries).withColumnRenamed("key", "list_key").select("*", every)
    active = (F.col("key") == F.col("list_key")) & (F.col("part") == F.col("list_part")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = probes.join(lists, active, "inner").select("id", "url", "fetched", F.struct(F.length("list_key").alias("n"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("a"), "list_key", "since").alias("hit"))
    best = met.groupBy("id", "url", "fetched").agg(F.max("hit").alias("hit")).toDF("id_", "url_", "fetched_", "hit")
    out = rows.join(best, rows.id.eqNullSafe(best.id_) & rows.url.eqNullSafe(best.url_) & rows.fetched.eqNullSafe(best.fetched_), "left")
    decision = F.when(host_of(F.col("url")).isNull(), "invalid").when(F.col("hit").isNull(), "pass").when(F.col("hit.a") == 1, "allow").otherwise("block")
    return out.select(F.col("id").alias(id_column), host_of(F.col("url")).alias("host"), "fetched", decision.alias("decision"), F.col("hit.list_key").alias("matched_key"), F.col("hit.since").alias("since"))


#: The rules of the query's list: which keys, key, action, day of 2024; c is a hash of the host.
_HOST_RULES = (
    ("c % 4 < 2", "host", "block", "c % 300"),
    ("c % 4 = 1", "host", "remove", "c % 300 + 40"),
    ("c % 8 = 1", "host", "block", "c % 300 + 55"),
    ("c % 5 = 0", "host || '/en'", "allow", "c % 200"),
)
_PARENT_RULES = (("c % 3 = 0", "host", "block", "c % 300"), ("c % 3 = 0", "host", "remove", "c % 300 + 30"))


def _day(expression: str) -> str:
    return f"date_add(date'2024-01-01', cast({expression} as int))"


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` against a dated list made of their own hosts.

    The tables have neither fetch times nor lists, so both follow from fixed
    rules: a page is fetched on day (page_id * 37) mod 360 of 2024. By a hash of
    its name, a host is blocked from one day on, and for some that is removed, and
    set again, later; some hosts have an allowed path; some parent domains are
    blocked for 30 days.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(_day("(page_id * 37) % 360")).cast("timestamp"))
    code = F.expr("cast(conv(substr(md5(host), 1, 7), 16, 10) as bigint)")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    parents = hosts.where("host like '%.%'").select(F.regexp_replace("host", "^[^.]*[.]", "").alias("host")).distinct()
    listed = None
    for names, rules in ((hosts.withColumn("c", code), _HOST_RULES), (parents.withColumn("c", code), _PARENT_RULES)):
        rule = F.explode(F.array(*(F.when(F.expr(where), F.struct(F.expr(key).alias("key"), F.lit(action).alias("action"), F.expr(_day(day)).alias("since"))) for where, key, action, day in rules)))
        part = names.select(rule.alias("rule")).where("rule is not null").select("rule.*")
        listed = part if listed is None else listed.unionByName(part)
    return filter_captures(captures, listed).select("page_id", "host", F.to_date("fetched").alias("fetched"), "decision", "matched_key", F.to_date("since").alias("since"))


def _sql() -> str:
    day = lambda x: f"(date '2024-01-01' + ({x})::int)"
    rules = [f"select {key} as key, '{action}' as action, {day(d)} as since from {names} where {where}" for names, own in (("hosts", _HOST_RULES), ("parents", _PARENT_RULES)) for where, key, action, d in own]
    return f"""
with p as (
  select page_id, url, {day("(page_id * 37) % 360")} as fetched,
    nullif(lower(regexp_replace(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '\\.+$', '')), '') as host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '{_PATH}', 1), '/'), lambda x: x <> '') as steps
  from pages),
names as (select distinct host from p where host is not null),
hosts as (select host, ('0x' || substr(md5(host), 1, 7))::bigint as c from names),
parents as (select distinct host, ('0x' || substr(md5(host), 1, 7))::bigint as c from (select regexp_replace(host, '^[^.]*[.]', '') as host from names where host like '%.%')),
entries as ({" union all ".join(rules)}),
ranked as (select key, since, arg_max(action, case action when 'remove' then 3 when 'allow' then 2 else 1 end) as action from entries group by key, since),
intervals as (select *, lead(since) over (partition by key order by since) as until from ranked),
probes as (
  select distinct page_id, fetched, unnest(
    [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)] ||
    [host || '/' || array_to_string(steps[1:i], '/') for i in range(1, len(steps) + 1)]) as key
  from p where host is not null),
met as (
  select page_id, i.key, i.action, i.since,
    row_number() over (partition by page_id order by length(i.key) desc, (i.action = 'allow')::int desc, i.key desc, i.since desc) as n
  from probes join intervals i on probes.key = i.key and fetched >= since and (until is null or fetched < until)
  where i.action <> 'remove')
select p.page_id, host, fetched,
  case when host is null then 'invalid' when m.key is null then 'pass' else m.action end as decision, m.key as matched_key, m.since as since
from p left join met m on p.page_id = m.page_id and m.n = 1
"""


OP3_SQL = _sql()
