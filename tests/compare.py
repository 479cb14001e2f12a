"""Run queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

import datetime
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    columns, kinds = rel.columns, {c: str(k) for c, k in zip(rel.columns, rel.types)}
    want = [tuple(map(plain, r)) for r in rel.fetchall()]
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; {kinds}"
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, bool) else (False, "b", x) for x in r))
    a, b = sorted(got, key=str), sorted(want, key=str)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}; {order and kinds}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            if name in oracles:
                said = difference(session, sys.argv[1], queries[name], oracles[name])
            else:
                said = f"no SQL; {queries[name](session, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name} {time.time() - began:.1f}s {said or 'same'}", flush=True)
