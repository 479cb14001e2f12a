"""Queries that write an index and answer from it, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, retrieval
from ..sources.scratch import shared_path
from .catalogue import _TERMS, ORACLES, query
from .offers import table


@query("indexed_bm25_topk", ORACLES["bm25_topk"])
def indexed_bm25_topk(spark, sf_dir):
    """The rows of ``bm25_topk`` from written postings of all ``documents``."""
    path = index.write_postings(table(spark, sf_dir, "documents"), "doc_id", ["text"], shared_path(spark, "postings"))
    scored = index.bm25_lookup(spark, path, _TERMS, {"text": 1.0}, top=None)
    return scored.select(F.col("key").alias("doc_id"), F.round("score", 3).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


_PHRASES = ["mit license", "apache license ver", "the th"]
_TOKENS = r"list_filter(regexp_split_to_array(translate(lower(coalesce({}, '')), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '')"


def _phrase_sql(words: list[str], of: str) -> str:
    last = len(words) - 1
    tests = " and ".join(f"w[i + {k}] = '{x}'" if k < last else f"starts_with(w[i + {k}], '{x}')" for k, x in enumerate(words))
    return f"len(list_filter(range(1, len({of}) + {1 - last}), lambda i: {tests.replace('w[', of + '[')}))"


@query("indexed_phrases", f"""with d as (select doc_id, {_TOKENS.format("text")} as w from documents)
select * from ({" union all ".join(f"select doc_id, '{p}' as q, {_phrase_sql(p.split(), 'w')}::bigint as places from d" for p in _PHRASES)}) where places > 0""")
def indexed_phrases(spark, sf_dir):
    """Where three phrases stand, the last word of each a prefix."""
    path = index.write_postings(table(spark, sf_dir, "documents"), "doc_id", ["text"], shared_path(spark, "postings"))
    found = index.found_terms(spark, path, _PHRASES, {"text": 1.0})
    return found.select(F.col("key").alias("doc_id"), "q", F.col("f").cast("bigint").alias("places"))


#: Title, brand and blob weigh 6, 4 and 1.
_WEIGHTS = {"title": 6.0, "brand": 4.0, "blob": 1.0}
_ASKED = ["brand 1", "re", "size 7"]


@query("indexed_products", f"""with d as (select p_partkey as product_id, p_name as title, p_brand as brand, concat_ws(' ', p_name, p_brand, p_type, 'size ' || p_size) as blob from part),
w as (select product_id, {", ".join(f"{_TOKENS.format(c)} as {c}" for c in _WEIGHTS)} from d),
len as (select product_id, len(title) + len(brand) + len(blob) as dl from w), tot as (select count(*)::double as n, avg(dl) as al from len where dl > 0),
qf as (select * from ({" union all ".join(f"select product_id, '{p}' as q, {' + '.join(f'{v} * ' + _phrase_sql(p.split(), c) for c, v in _WEIGHTS.items())} as f from w" for p in _ASKED)}) where f > 0),
df as (select q, count(*)::double as df from qf group by q)
select product_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / al))), 3) as score from qf join df using (q) join len using (product_id) cross join tot group by product_id""")
def indexed_products(spark, sf_dir):
    """Products by title, brand and blob, weighted: two phrases and a prefix."""
    blob = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), blob.alias("blob"))
    path = index.write_postings(rows, "product_id", list(_WEIGHTS), shared_path(spark, "postings"))
    return index.bm25_lookup(spark, path, _ASKED, _WEIGHTS, top=None).select(F.col("key").alias("product_id"), F.round("score", 3).alias("score"))


@query("trigram_match", ORACLES["substring_match"])
def trigram_match(spark, sf_dir):
    """The rows of ``substring_match`` from a written trigram index of all ``documents``."""
    path = index.write_trigrams(table(spark, sf_dir, "documents"), "doc_id", "text", shared_path(spark, "trigrams"))
    return index.substring_lookup(spark, path, _TERMS, top=None).select(F.col("key").alias("doc_id"), "score")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: length(t) >= 4)"


@query("fuzzy_nearest", f"""with v as (select form, -count(*)::bigint as priority from (select unnest({_WORDS}) as form from documents) group by form),
w as (select distinct unnest({_WORDS}) as word from benchmark),
m as (select word, form, priority, levenshtein(word, form)::int as distance from w join v on abs(length(word) - length(form)) <= 2 where word <> form and levenshtein(word, form) <= 2)
select word, form, distance from m qualify row_number() over (partition by word order by distance, priority, form) = 1""")
def fuzzy_nearest(spark, sf_dir):
    """For every word of the benchmark, the nearest other word of all documents, the more frequent first."""
    split = lambda name: table(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 4)
    vocabulary = split("documents").groupBy("w").agg((-F.count("*")).alias("priority")).withColumnRenamed("w", "form")
    return retrieval.correct_words(split("benchmark").withColumnRenamed("w", "word"), vocabulary)
