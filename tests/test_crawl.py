"""Crawls: passes, caps, dry passes, closing of targets, and going on after a break."""

import pytest
from pyspark.sql import functions as F

from ratecard.sources import crawl


def site(pages):
    """target name -> pages, each a list of refs."""
    return [(s, "c", "r", n, ref) for s, own in pages.items() for n, refs in enumerate(own, 1) for ref in (refs or [None])]


def test_passes(spark, tmp_path):
    pages = {"a": [["1", "2"], ["2", "3"], ["4"], ["4"], ["1"], ["2"], ["9"]], "b": [["1"], []], "gone": []}
    df = spark.createDataFrame(site(pages), "source_id string, category string, region string, page long, source_ref string")
    sources = spark.createDataFrame([(s, [("c", "r"), ("other", "r")]) for s in pages], "source_id string, covers array<struct<category:string,region:string>>")
    targets = crawl.dispatch(sources, spark.createDataFrame([("c", "r"), ("c", "elsewhere")], "category string, region string"))
    assert sorted(tuple(r) for r in targets.collect()) == [(s, "c", "r") for s in ("a", "b", "gone")]
    asked_for = []

    def read(asked):
        asked_for.append(sorted((r.source_id, r.first_page) for r in asked.collect()))
        return df.join(asked, crawl.TARGET).where("page >= first_page and page < first_page + asked").select(df.columns)

    root = str(tmp_path / "one")
    n = crawl.crawl(targets, read, root, cap=1)
    got = {(r.source_id, r.source_ref): (r["pass"], r.page) for r in crawl.crawled(spark, root, n).collect()}
    assert got == {("a", "1"): (1, 1), ("a", "2"): (1, 1), ("b", "1"): (1, 1), ("a", "3"): (2, 2), ("a", "4"): (3, 3)}
    assert n == 5 and asked_for[-1] == [("a", 5)]  # passes 4 and 5 are dry, so the 9 of page 7 is not met
    declared = targets.withColumn("declared", F.when(F.col("source_id") == "a", 7))
    assert {r.source_id: (r.pages, r.captured, r.missed) for r in crawl.remainder(spark, root, n, declared).collect()} == {"a": (5, 4, 3), "b": (2, 1, 0), "gone": (0, 0, 0)}
    wide = str(tmp_path / "wide")
    n = crawl.crawl(targets, read, wide, cap=4)
    assert n == 2 and ("a", "9") in {(r.source_id, r.source_ref) for r in crawl.crawled(spark, wide, n).collect()}

    class Broke(Exception):
        pass

    def breaks(asked):
        if asked.first().first_page > 2:
            raise Broke
        return read(asked)

    again = str(tmp_path / "again")
    with pytest.raises(Broke):
        crawl.crawl(targets, breaks, again, cap=1)
    assert crawl.whole_passes(spark, again) == 2
    asked_for.clear()
    assert crawl.crawl(targets, read, again, cap=1) == 5 and asked_for[0][0] == ("a", 3)
    assert {(r.source_id, r.source_ref): (r["pass"], r.page) for r in crawl.crawled(spark, again, 5).collect()} == got
