"""Retrieval: an inverted index as a table, BM25, substrings, fusion, suggestions."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

K1, B = 1.2, 0.75
#: How lexical and substring scores are mixed, and how many of either are kept.
LEXICAL_SHARE, SUBSTRING_SHARE = 0.75, 0.25
LEXICAL_TOP, SUBSTRING_TOP = 600, 400


def _plain_letters() -> tuple[str, str]:
    """Small Latin letters with a diacritic, and the same without."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xE0, 0x180), *range(0x1CD, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1 and c.islower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_PLAIN = _plain_letters()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; Latin diacritics removed (``_PLAIN``)."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """(term, key, tf, weighted_tf, length): one row for each term of each document.

    Terms are counted where they are read (a partial aggregate), so a very common
    word never gathers its occurrences in one task.
    """
    parts = None
    for name, weight in columns.items():
        own = docs.select(key, F.explode(tokens(F.col(name))).alias("term"), F.lit(float(weight)).alias("w"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy(key, "term").agg(F.count("*").alias("tf"), F.sum("w").alias("weighted_tf"))


def bm25(index: DataFrame, key: str, terms: list[str], prefix: bool = True, top: int | None = LEXICAL_TOP) -> DataFrame:
    """(key, score) of documents with any of ``terms``; with ``prefix`` a term stands for all that begin with it.

    Statistics are two small aggregates over the index; the terms' documents are
    a filtered scan of it. The score is rounded to 9 places.
    """
    lengths = index.groupBy(key).agg(F.sum("tf").alias("length"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    hit = lambda t: F.col("term").startswith(t) if prefix else F.col("term") == t
    which = F.array_compact(F.array(*(F.when(hit(t), F.lit(t)) for t in terms)))
    any_hit = None
    for t in terms:
        any_hit = hit(t) if any_hit is None else any_hit | hit(t)
    if any_hit is None:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    found = index.where(any_hit).select(key, F.explode(which).alias("query_term"), "weighted_tf").groupBy(key, "query_term").agg(F.sum("weighted_tf").alias("f"))
    df = found.groupBy("query_term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(df), "query_term").join(lengths, key).join(F.broadcast(totals))  # a row for each query term, and one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = rows.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), key).limit(top)


def bm25_scan(docs: DataFrame, key: str, columns: dict[str, float], terms: list[str], prefix: bool = True, top: int | None = LEXICAL_TOP) -> DataFrame:
    """What ``bm25`` gives over ``postings``, straight from the texts: without an index
    only the query's terms need counting, so every text becomes one narrow row where it
    is read, which is written, and nothing is shuffled but sums."""
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)

    def count(words: str, term: str) -> Column:
        return F.size(F.filter(words, lambda x: x.startswith(term) if prefix else x == term))

    words = docs.select(key, *(tokens(F.col(c)).alias(f"_w{i}") for i, c in enumerate(columns)))
    length = sum((F.size(f"_w{i}") for i in range(len(columns))), F.lit(0))
    found = [sum((count(f"_w{i}", t) * w for i, w in enumerate(columns.values())), F.lit(0.0)) for t in terms]
    # written once: a filter on what is derived here would split every text again, and so would each further use
    rows = stored(words.select(key, length.alias("length"), *(f.alias(f"f{j}") for j, f in enumerate(found))), "term_counts").where("length > 0")
    totals = rows.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), *(F.count_if(F.col(f"f{j}") > 0).alias(f"df{j}") for j in range(len(terms))))
    score = F.lit(0.0)
    for j in range(len(terms)):
        weight = F.log(1 + (F.col("n_docs") - F.col(f"df{j}") + 0.5) / (F.col(f"df{j}") + 0.5))
        score = score + weight * F.col(f"f{j}") * (K1 + 1) / (F.col(f"f{j}") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    any_hit = sum((F.col(f"f{j}") for j in range(len(terms))), F.lit(0.0)) > 0
    scored = rows.where(any_hit).join(F.broadcast(totals)).select(key, F.round(score, 6).alias("score"))  # one row
    return scored if top is None else scored.orderBy(F.desc("score"), key).limit(top)


def substring_scores(docs: DataFrame, key: str, text: str, terms: list[str], top: int | None = SUBSTRING_TOP) -> DataFrame:
    """(key, score): places where any term of three characters or more stands in the text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    count = F.lit(0)
    for t in (t for t in terms if len(t) >= 3):
        count = count + ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    scored = docs.select(key, count.cast("double").alias("score")).where("score > 0")
    return scored if top is None else scored.orderBy(F.desc("score"), key).limit(top)


def fuse(lexical: DataFrame, substring: DataFrame, key: str) -> DataFrame:
    """(key, relevance): each list from 0 to 1, mixed; a document missing from one counts 0 there."""

    def scaled(scores: DataFrame, name: str) -> DataFrame:
        ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
        span = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.col("high") - F.col("low"))
        return scores.join(F.broadcast(ends)).select(key, ((F.col("score") - F.col("low")) / span).alias(name))

    lexical, substring = stored(lexical, "lexical"), stored(substring, "substring")  # narrow, and read twice each
    both = scaled(lexical, "l").join(scaled(substring, "s"), key, "full")
    return both.select(key, (LEXICAL_SHARE * F.coalesce("l", F.lit(0.0)) + SUBSTRING_SHARE * F.coalesce("s", F.lit(0.0))).alias("relevance"))


def contains(text: Column, part: str) -> Column:
    """Literal containment without case: signs of LIKE mean themselves."""
    return F.lower(text).contains(part.lower())


def suggest(rows: DataFrame, prefix: str, n: int = 8) -> DataFrame:
    """The cheapest products whose title contains what was typed."""
    return rows.where(contains(F.col("title"), prefix)).groupBy("product_id", "title").agg(F.min("landed_minor").alias("landed_minor")).orderBy("landed_minor", "product_id").limit(n)


def trending(log: DataFrame, n: int = 6) -> DataFrame:
    """(q, n, latest): the most frequent queries that found something; ties by the latest."""
    return log.where("hits > 0").groupBy("q").agg(F.count("*").alias("n"), F.max("at").alias("latest")).orderBy(F.desc("n"), F.desc("latest"), "q").limit(n)


def match_strength(rows: DataFrame, text: str, query: str, stop: frozenset[str] = frozenset("a an and for in of on or the to with".split())) -> DataFrame:
    """(share, verdict) of rows that contain any meaningful word of the query."""
    words = [w for w in query.lower().split() if len(w) >= 2 and w not in stop]
    hit = F.lit(False)
    for w in words:
        hit = hit | contains(F.col(text), w)
    share = F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))
    return rows.agg(F.round(share, 6).alias("share")).withColumn("verdict", F.when(F.col("share") == 0, "NO_MATCH").when(F.col("share") < 0.5, "weak").otherwise("ok"))


#: Longer forms are met by pieces, shorter ones by what deletions leave of them.
LONG_FORM = 16


def _without_one(word: Column) -> Column:
    """The strings that a word is without one of its characters."""
    left = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, left).otherwise(F.array().cast("array<string>"))


def deletion_keys(word: Column) -> Column:
    """A word and all that is left of it without one or two characters. Two words within
    two edits share one: an edit deletes a character of either or of both."""
    once = _without_one(word)
    twice = F.flatten(F.transform(once, _without_one))
    return F.transform(F.array_distinct(F.concat(F.array(word), once, twice)), lambda k: F.concat(F.lit("d:"), k))


def _piece_key(length: Column, piece: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("p"), length.cast("string"), piece.cast("string"), text)


def piece_keys(form: Column) -> Column:
    """The thirds of a form, each with its place and the form's length: two edits leave one of them whole."""
    n = F.length(form)
    start = lambda i: F.floor(n * i / 3).cast("int")
    return F.transform(F.array(*map(F.lit, range(3))), lambda i: _piece_key(n, i, F.substring(form, start(i) + 1, start(i + 1) - start(i))))


def probe_keys(word: Column, most: int = 2) -> Column:
    """The keys of thirds that forms within ``most`` edits of a word can have: every length and shift in reach."""
    n = F.length(word)

    def of_length(length: Column) -> Column:
        start = lambda i: F.floor(length * i / 3).cast("int")

        def of_piece(i: Column) -> Column:
            size = start(i + 1) - start(i)
            at = F.transform(F.array(*map(F.lit, range(-most, most + 1))), lambda s: start(i) + s)
            at = F.filter(at, lambda p: (p >= 0) & (p + size <= n))
            return F.transform(at, lambda p: _piece_key(length, i, F.substring(word, p + 1, size)))

        return F.flatten(F.transform(F.array(*map(F.lit, range(3))), of_piece))

    lengths = F.filter(F.transform(F.array(*map(F.lit, range(-most, most + 1))), lambda d: n + d), lambda length: length > LONG_FORM)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def near_pairs(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, form, distance, and what else ``vocabulary`` has) of all words within two edits of each other, maybe more than once.

    An equi-join on keys: what deletions leave of short forms, thirds of long ones.
    Words near the limit have both, so no pair is lost, and a pair that shares a key
    is verified where it meets.
    """
    none = F.array().cast("array<string>")
    n = F.length("word")
    own = F.concat(F.when(n <= LONG_FORM + 2, deletion_keys(F.col("word"))).otherwise(none), F.when(n >= LONG_FORM - 1, probe_keys(F.col("word"))).otherwise(none))
    theirs = F.when(F.length("form") <= LONG_FORM, deletion_keys(F.col("form"))).otherwise(piece_keys(F.col("form")))
    left = words.select("word", F.explode(own).alias("_key"))
    right = vocabulary.withColumn("_key", F.explode(theirs))
    near = left.join(right, "_key").drop("_key")
    return near.withColumn("distance", F.levenshtein("word", "form", 2)).where("distance >= 0")


def correct_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, form, distance): the nearest other form within two edits of words of
    four letters or more; ties by priority, then form."""
    w = words.where(F.length("word") >= 4).select("word").distinct()
    near = near_pairs(w, vocabulary.select("form", "priority")).where("distance > 0")
    return near.groupBy("word").agg(F.min(F.struct("distance", "priority", "form")).alias("best")).select("word", "best.form", "best.distance")


def idf(n_docs: int, df: int) -> float:
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))
