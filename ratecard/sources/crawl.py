"""Crawls as fixpoints: sources by category and region, pages by passes, state on shared storage.

Each pass asks every open target for its next ``cap`` pages, all in one job. New
listings are those that no earlier page or pass had. A target closes when it gives
fewer pages than it was asked for; a crawl ends when no target is open, or after
``dry`` passes in a row with nothing new. A pass is written before the next begins,
its attempts last, so a crawl that broke off goes on after its last whole pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listings import missed_listings, new_listings, passes_done
from .sinks import _files

TARGET = ["source_id", "category", "region"]
ATTEMPT = "source_id string, category string, region string, first_page bigint, asked bigint, pages bigint, cards bigint, fresh bigint"


def dispatch(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The targets: what each source (source_id, covers: array of category and region) covers of what is ``wanted`` (category, region)."""
    covered = sources.select("source_id", F.explode("covers").alias("c")).select("source_id", "c.category", "c.region").distinct()
    return covered.join(wanted.select("category", "region").distinct(), ["category", "region"], "left_semi").select(*TARGET)


def whole_passes(spark: SparkSession, root: str) -> int:
    """How many passes were written whole."""
    fs, path = _files(spark, root)
    names = {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
    done = 0
    while f"attempts-{done + 1:06d}" in names and fs.exists(_files(spark, f"{root}/attempts-{done + 1:06d}/_SUCCESS")[1]):
        done += 1
    return done


def _all(spark: SparkSession, root: str, kind: str, n: int) -> DataFrame:
    return spark.read.parquet(*(f"{root}/{kind}-{i:06d}" for i in range(1, n + 1)))


def crawl(targets: DataFrame, read: Callable[[DataFrame], DataFrame], root: str, cap: int, dry: int = 2, most: int | None = None) -> int:
    """Run passes until nothing is new; how many there are. ``read`` gives the cards (target, page, source_ref, ...) of
    the pages that are asked for (target, first_page, asked); an empty page gives one card without a source_ref."""
    spark = targets.sparkSession
    done = whole_passes(spark, root)
    fresh = [r.fresh for r in _all(spark, root, "attempts", done).groupBy(F.input_file_name().alias("f")).agg(F.sum("fresh").alias("fresh")).orderBy(F.regexp_extract("f", r"attempts-(\d+)", 1)).collect()] if done else []
    while not passes_done(fresh, dry) and (most is None or done < most):
        if done:
            last = spark.read.parquet(f"{root}/attempts-{done:06d}")
            open_ = last.where("pages >= asked").select(*TARGET, (F.col("first_page") + F.col("asked")).alias("first_page"))
        else:
            open_ = targets.select(*TARGET, F.lit(1).cast("bigint").alias("first_page"))
        asked = open_.withColumn("asked", F.lit(cap).cast("bigint"))
        if asked.isEmpty():
            break
        cards = read(asked)
        cards.write.mode("overwrite").parquet(f"{root}/raw-{done + 1:06d}")
        cards = spark.read.parquet(f"{root}/raw-{done + 1:06d}")
        held = cards.where("source_ref is not null")
        new = new_listings(held, _all(spark, root, "new", done)) if done else new_listings(held, held.limit(0))
        new.withColumn("pass", F.lit(done + 1)).write.mode("overwrite").parquet(f"{root}/new-{done + 1:06d}")
        found = spark.read.parquet(f"{root}/new-{done + 1:06d}").groupBy(*TARGET).agg(F.count("*").alias("fresh"))
        counts = cards.groupBy(*TARGET).agg(F.countDistinct("page").alias("pages"), F.count("source_ref").alias("cards"))
        attempts = asked.join(counts, TARGET, "left").join(found, TARGET, "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        attempts.select(*TARGET, "first_page", "asked", zero("pages"), zero("cards"), zero("fresh")).write.mode("overwrite").parquet(f"{root}/attempts-{done + 1:06d}")
        done += 1
        fresh.append(spark.read.parquet(f"{root}/attempts-{done:06d}").agg(F.sum("fresh")).first()[0] or 0)
    return done


def crawled(spark: SparkSession, root: str, passes: int) -> DataFrame:
    """The listings of all passes, each once, with the pass that found it."""
    return _all(spark, root, "new", passes)


def remainder(spark: SparkSession, root: str, passes: int, declared: DataFrame) -> DataFrame:
    """(target, pages, captured, missed) of each target; ``declared`` (target, declared): how many listings it says it has."""
    totals = _all(spark, root, "attempts", passes).groupBy(*TARGET).agg(F.sum("pages").alias("pages"), F.sum("fresh").alias("captured"))
    missed = missed_listings(F.col("declared"), F.lit(0), F.col("pages"), F.col("captured"))
    return totals.join(declared, TARGET, "left").select(*TARGET, "pages", "captured", missed.cast("bigint").alias("missed"))
