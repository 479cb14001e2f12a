"""Writing: versioned snapshots, histories, archives, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import format_minor

#: Columns of the flat snapshot, in its order.
SNAPSHOT = ("category", "region", "product_id", "title", "brand", "vendor_id", "vendor_name", "offer_key", "stock_state", "moq", "lead_days", "base", "gst", "freight", "handling", "loading", "landed", "fetched_at")


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _markers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(place, version) of everything that was published, in order."""
    fs, path = _files(spark, f"{root}/_published")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names)


def publish(df: DataFrame, root: str, version: str, *partition_by: str) -> str:
    """Write a version of a table, then publish it by creating one empty file, the
    last of which names the version that is read: readers see all of it or nothing."""
    spark = df.sparkSession
    path = f"{root}/version={version}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    place = max((n for n, _ in _markers(spark, root)), default=0) + 1
    fs, marker = _files(spark, f"{root}/_published/{place:08d}-{version}")
    fs.create(marker, False).close()
    return path


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first."""
    return list(dict.fromkeys(v for _, v in _markers(spark, root)))


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version}")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was published last."""
    markers = _markers(spark, root)
    if not markers:
        raise FileNotFoundError(f"nothing is published below {root}")
    return read_version(spark, root, markers[-1][1])


def append_history(df: DataFrame, path: str, run_id: str, trigger: str) -> None:
    """Append-only observations, one directory for each run."""
    df.withColumns({"run_id": F.lit(run_id), "trigger": F.lit(trigger)}).write.mode("append").partitionBy("run_id").parquet(path)


def archive_raw(raw: DataFrame, path: str) -> None:
    """Append raw rows as JSON lines; assisted captures are archived where they come from."""
    raw.where("fetch_mode is null or fetch_mode <> 'assisted'").write.mode("append").json(path)


def snapshot_rows(rows: DataFrame) -> DataFrame:
    """The flat snapshot with money as rupees of two decimals."""
    rupees = lambda c: F.format_string("%.2f", F.col(c) / 100)
    money = {n: rupees(f"{n}_minor") for n in ("base", "gst", "freight", "handling", "loading", "landed")}
    return rows.withColumns(money).select(*SNAPSHOT)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A CSV (quoted as RFC 4180 asks) and a summary in JSON for each category."""
    flat = snapshot_rows(rows)
    flat.write.mode("overwrite").partitionBy("category").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/csv")
    counts = rows.groupBy("category").agg(F.count("*").alias("offers"), F.countDistinct("region").alias("regions"), F.countDistinct("vendor_id").alias("vendors"), F.countDistinct("brand").alias("brands"))
    counts.write.mode("overwrite").json(f"{path}/json")


def keep_history_on_rebuild(history: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History under the product that each offer belongs to now, and what no offer claims any more."""
    now = offers.select("offer_id", "product_id")
    return history.drop("product_id").join(now, "offer_id"), history.join(now, "offer_id", "left_anti")


def upsert_pictures(known: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("product_id", "asset")) -> DataFrame:
    """Pictures by product and asset; the widest address wins, a local copy is kept, kinds rank photos first."""
    rank = F.when(F.col("kind") == "photo", 0).when(F.col("kind") == "chart", 1).when(F.col("kind") == "certificate", 2).otherwise(3)
    both = known.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by("url", F.struct("width", "url")).alias("url"), F.max("width").alias("width"), F.max("local_path").alias("local_path"), F.min_by("kind", F.struct(rank.alias("rank"), "url")).alias("kind"), F.min(rank).alias("rank"))


def seed(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> None:
    """Write reference tables; a second time changes nothing but what differs: keys keep one row, the new one."""
    for name, rows in tables.items():
        published = versions(spark, f"{root}/{name}")
        if published:
            old = current(spark, f"{root}/{name}").join(rows.select(*keys[name]), keys[name], "left_anti")
            rows = old.unionByName(rows)
        publish(rows.dropDuplicates(keys[name]), f"{root}/{name}", f"{len(published) + 1:08d}")


def facet_config(spark: SparkSession, trees: list[dict]) -> DataFrame:
    """Authored facets as a table; a facet is visible unless it says otherwise or is backed by no data."""
    schema = "category string, facet_id string, label string, facet_key string, position int, visible boolean, values array<struct<label:string,sublabel:string,unit:string,reveals:array<string>>>"
    rows = [
        (t["category"], f["id"], f["label"], f["key"], i, bool(f.get("visible", f.get("data_backed", True))), [(v["label"], v.get("sublabel"), v.get("unit"), v.get("reveals", [])) for v in f["values"]])
        for t in trees
        for i, f in enumerate(t["facets"])
    ]
    return spark.createDataFrame(rows, schema)


def log_attempts(rows: DataFrame, path: str, run_id: str) -> None:
    """Append a run's attempts and what they came to."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def write_captures(rows: DataFrame, path: str) -> None:
    """Captures taken by hand, as the JSON lines that readers of assisted sources expect."""
    rows.withColumn("fetch_mode", F.lit("assisted")).write.mode("append").json(path)


def compact(df: DataFrame, path: str, files: int) -> int:
    """A compact read-only copy; an empty one is refused."""
    n = df.count()
    if not n:
        raise ValueError("an empty snapshot is not published")
    df.repartition(files).write.mode("overwrite").parquet(path)
    return n


def replace_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the keyed partitions that ``df`` has, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small aggregate as a table of text; beyond ``most`` rows the rest is counted."""
    rows = df.limit(most + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most])
    more = "\n\nMore rows are not shown." if len(rows) > most else ""
    return f"## {title}\n\n{head}\n{body}{more}\n"


def query_log(spark: SparkSession, path: str, q: str, region: str, hits: int, at) -> bool:
    """Append one search; a failing log never fails the search."""
    try:
        spark.createDataFrame([(q.strip().lower(), region, hits, at)], "q string, region string, hits int, at timestamp").write.mode("append").json(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def reattach_pictures(pictures: DataFrame, offers: DataFrame) -> DataFrame:
    """Pictures by the product that their offer belongs to now; one of each asset."""
    return pictures.drop("product_id").join(offers.select("offer_id", "product_id"), "offer_id").groupBy("product_id", "asset").agg(F.max_by(F.struct("offer_id", "url", "width"), F.struct("width", "url")).alias("p")).select("product_id", "asset", "p.*")


__all__ = ["append_history", "archive_raw", "compact", "current", "format_minor", "markdown", "publish", "query_log", "read_version", "reattach_pictures", "replace_partition", "snapshot_rows", "versions", "write_snapshot"]
