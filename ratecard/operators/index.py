"""Written indexes: word postings with positions, and trigrams with the texts they lead to.

Both are Parquet below one path, range-partitioned and sorted by term, in pages of
few rows with column indexes, so that a term, or all terms with a prefix, is a
range of the files: what does not overlap it is not read. A very common term is
many rows, sorted further by document, and spreads over as many files as it needs.

====================  ====================================================
``postings``          term, column, key, pos, length (words of the document)
``totals``            n_docs, mean_length: one row
``grams``             gram, key, n (places in the text, however they overlap)
``gram_sizes``        gram, n_docs
``blocks``            how many blocks of texts there are
``texts/block=…``     key, low: lower-cased texts, in blocks by a hash of the key
====================  ====================================================

Keys are unique and not null. Null and empty texts have no postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import B, K1, LEXICAL_TOP, SUBSTRING_TOP, tokens

#: Rows of a page and bytes of a row group: what a lookup reads at least.
PAGE_ROWS, GROUP_BYTES = 4_000, 16 << 20
#: Characters of a block of texts on average, and how many of a term's rarest trigrams are intersected before texts are read.
BLOCK_CHARS, RAREST = 8_000_000, 3


def _write(rows: DataFrame, path: str, *order: str) -> None:
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", GROUP_BYTES).option("parquet.writer.version", "PARQUET_2_0").parquet(path)


def after_prefix(prefix: str) -> str | None:
    """The least string above all that begin with ``prefix``; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            following = ord(prefix[i]) + 1
            return prefix[:i] + chr(0xE000 if 0xD800 <= following < 0xE000 else following)
    return None


def in_range(column: str, prefix: str) -> Column:
    """That a column begins with ``prefix``, as bounds that the scan can prune by."""
    above = after_prefix(prefix)
    low = F.col(column) >= prefix
    return low if above is None else low & (F.col(column) < above)


def _placed(column: str) -> Column:
    """The words of a column, each with its place."""
    return F.transform(tokens(F.col(column)), lambda t, i: F.struct(t.alias("term"), F.lit(column).alias("column"), i.alias("pos")))


def write_postings(docs: DataFrame, key: str, columns: list[str], path: str) -> str:
    """Index the words of ``columns`` of ``docs``: one shuffle, one row for each word."""
    words = F.concat(*(_placed(c) for c in columns))
    held = docs.select(F.col(key).alias("key"), words.alias("words"))
    _write(held.select("key", F.size("words").alias("length"), F.explode("words").alias("w")).select("w.term", "w.column", "key", "w.pos", "length"), f"{path}/postings", "term", "key", "column", "pos")
    rows = docs.sparkSession.read.parquet(f"{path}/postings")
    # every document with words has one at place 0 of some column
    first = rows.where("pos = 0").agg(F.countDistinct("key").alias("n_docs"))
    rows.agg(F.count("*").alias("words")).join(first).select("n_docs", (F.col("words") / F.col("n_docs")).alias("mean_length")).write.parquet(f"{path}/totals")
    return path


def found_terms(spark: SparkSession, path: str, terms: list[str], weights: dict[str, float], prefix: bool = True) -> DataFrame:
    """(key, length, q, f): weighted occurrences of each of ``terms`` in each document that has it.

    A term of several words is a phrase: its words stand one after the other in one
    column. With ``prefix`` the last word stands for all that begin with it. All
    terms are one scan of the union of their ranges; places of a phrase are counted
    by where they begin, so no posting is joined with another.
    """
    queries = [t.split() for t in dict.fromkeys(terms) if t.split()]
    hit = lambda q, i: in_range("term", q[i]) if prefix and i == len(q) - 1 else F.col("term") == q[i]
    places = [(n, i, hit(q, i)) for n, q in enumerate(queries) for i in range(len(q))]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("column").isin(*weights) & reduce(lambda a, b: a | b, (h for _, _, h in places), F.lit(False)))
    which = F.array_compact(F.array(*(F.when(h, F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"))) for n, i, h in places))) if places else F.array().cast("array<struct<n:int,i:int>>")
    weight = reduce(lambda a, c: F.when(F.col("column") == c, F.lit(float(weights[c]))).otherwise(a), weights, F.lit(0.0))
    met = rows.select("key", "length", "column", "pos", weight.alias("w"), F.explode(which).alias("m")).select("key", "length", "column", "w", F.col("m.n").alias("n"), (F.col("pos") - F.col("m.i")).alias("start"))
    single = [n for n, q in enumerate(queries) if len(q) == 1]
    found = met.where(F.col("n").isin(*single)) if single else met.limit(0)
    if len(single) < len(queries):
        size = reduce(lambda a, n: F.when(F.col("n") == n, F.lit(len(queries[n]))).otherwise(a), range(len(queries)), F.lit(0))
        phrases = met.where(~F.col("n").isin(*single)) if single else met
        whole = phrases.groupBy("key", "length", "column", "w", "n", "start").agg(F.count("*").alias("held")).where(F.col("held") == size).drop("held")
        found = found.unionByName(whole)
    named = reduce(lambda a, n: F.when(F.col("n") == n, F.lit(" ".join(queries[n]))).otherwise(a), range(len(queries)), F.lit(None).cast("string"))
    return found.groupBy("key", "length", "n").agg(F.sum("w").alias("f")).select("key", "length", named.alias("q"), "f")


def bm25_lookup(spark: SparkSession, path: str, terms: list[str], weights: dict[str, float], prefix: bool = True, top: int | None = LEXICAL_TOP) -> DataFrame:
    """(key, score) of documents with any of ``terms``, from the written postings."""
    found = found_terms(spark, path, terms, weights, prefix)
    df = found.groupBy("q").agg(F.count("*").alias("df"))  # a row for each term
    totals = spark.read.parquet(f"{path}/totals")  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = found.join(F.broadcast(df), "q").join(F.broadcast(totals)).groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), "key").limit(top)


def trigrams(low: Column) -> Column:
    """All runs of three characters, one from each place (none from within a character of two UTF-16 units)."""
    return F.regexp_extract_all(low, F.lit(r"(?s)(?=([^\uDC00-\uDFFF]..))"), F.lit(1))


def write_trigrams(docs: DataFrame, key: str, text: str, path: str) -> str:
    """Index the lower-cased ``text`` of ``docs`` by trigrams, and keep the texts in blocks."""
    spark = docs.sparkSession
    low = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    chars = low.agg(F.sum(F.length("low")).alias("n")).first().n or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    spark.createDataFrame([(blocks,)], "blocks int").write.parquet(f"{path}/blocks")
    low.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block", "key").write.option("compression", "zstd").partitionBy("block").parquet(f"{path}/texts")
    grams = low.select("key", F.explode(trigrams(F.col("low"))).alias("gram")).groupBy("gram", "key").agg(F.count("*").alias("n"))
    _write(grams, f"{path}/grams", "gram", "key")
    sizes = spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count("*").alias("n_docs"))
    _write(sizes, f"{path}/gram_sizes", "gram")
    return path


def _stands_alone(gram: str) -> bool:
    """Whether a trigram's places never overlap, so that counting them is counting what replacing would."""
    return gram[0] != gram[2]


def gram_places(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(key, n): places where ``term`` stands, one after the other, in each text that has it.

    A term of three characters is its trigram. A longer one is looked for in the
    texts that hold its rarest trigrams (their sizes are read first: a row for each
    trigram of the term); of those only the blocks with such a text are read.
    """
    grams = spark.read.parquet(f"{path}/grams")
    if len(term) == 3 and _stands_alone(term):
        return grams.where(F.col("gram") == term).select("key", "n")
    wanted = list(dict.fromkeys(term[i : i + 3] for i in range(len(term) - 2)))
    sizes = {r.gram: r.n_docs for r in spark.read.parquet(f"{path}/gram_sizes").where(F.col("gram").isin(*wanted)).collect()}
    if len(sizes) < len(wanted):
        return grams.where(F.lit(False)).select("key", "n")
    rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:RAREST]
    keys = [grams.where(F.col("gram") == g).select("key") for g in rarest]
    candidates = reduce(lambda a, b: a.join(b, "key", "left_semi"), keys)
    texts = spark.read.parquet(f"{path}/texts")
    n_blocks = spark.read.parquet(f"{path}/blocks").first().blocks
    blocks = candidates.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("b")).distinct()
    held = texts.where(F.col("block").isin(*(r.b for r in blocks.collect()))).join(candidates, "key", "left_semi")
    n = ((F.length("low") - F.length(F.replace("low", F.lit(term), F.lit("")))) / len(term)).cast("bigint")
    return held.select("key", n.alias("n")).where("n > 0")


def substring_lookup(spark: SparkSession, path: str, terms: list[str], top: int | None = SUBSTRING_TOP) -> DataFrame:
    """(key, score): places where any term of three characters or more stands, from the written trigrams."""
    parts = [gram_places(spark, path, t) for t in terms if len(t) >= 3]
    if not parts:
        return spark.read.parquet(f"{path}/gram_sizes").select(F.lit(None).cast("bigint").alias("key"), F.lit(0.0).alias("score")).limit(0)
    scored = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("n").cast("double").alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), "key").limit(top)
