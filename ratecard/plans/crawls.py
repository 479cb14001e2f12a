"""The query of a crawl to its fixpoint, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import placed
from ..sources import crawl
from ..sources.scratch import shared_path, stored
from .catalogue import query
from .offers import table

_CAP = 20
_HOST, _LANG = r"^[a-z]+://([^/?#]+)", r"^[a-z]+://[^/?#]+/([a-z]+)/"


@query("crawl_fixpoint", f"""with p as (select regexp_extract(url, '{_HOST}', 1) as source_id, regexp_extract(url, '{_LANG}', 1) as category, page_id, html from pages),
n as (select *, row_number() over (partition by source_id, category order by page_id) as page from p),
c as (select source_id, category, page, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) as source_ref from n),
f as (select source_id, source_ref, min(((page - 1) // {_CAP}) + 1)::int as pass from c group by all),
k as (select i, (select count(*) from f where pass = i) as fresh from range(1, (select max(pass) from f) + 3) as r(i)),
stop as (select min(a.i) as last from k a join k b on b.i = a.i - 1 where a.fresh = 0 and b.fresh = 0)
select source_id, source_ref, pass from f where pass <= coalesce((select last from stop), pass)""")
def crawl_fixpoint(spark, sf_dir):
    """Hosts as sources, languages as categories: links as listings, found pass by pass until two passes are dry."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", _HOST, 1).alias("source_id"), F.regexp_extract("url", _LANG, 1).alias("category"), F.lit("all").alias("region"), "page_id", "html")
    site = stored(placed(pages, crawl.TARGET, [F.asc("page_id")], "page").drop("_total"), "site")

    def read(asked):
        wanted = site.join(asked, crawl.TARGET).where("page >= first_page and page < first_page + asked")
        refs = F.explode_outer(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
        return wanted.select(*crawl.TARGET, "page", refs.alias("source_ref"))

    sources = site.groupBy("source_id").agg(F.collect_set(F.struct("category", "region")).alias("covers"))
    targets = crawl.dispatch(sources, site.select("category", "region"))
    root = shared_path(spark, "crawl")
    passes = crawl.crawl(targets, read, root, _CAP)
    return crawl.crawled(spark, root, passes).select("source_id", "source_ref", "pass")
