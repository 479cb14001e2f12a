"""License scans by an exact set-similarity join, in DataFrame operations only.

Blocks are windows of a text's words, across line ends and within long lines, twice
as long as the longest template and overlapping by half, so that a template that is
wrapped over lines stands whole in one, and words scattered over a text never make
one. They are sets of distinct words (lower-cased A-Z; letters, digits and all
beyond ASCII). A block meets a template if it holds at least
``ceil(threshold * size)`` of the template's distinct words and, of those words that
tell it from templates of other labels, at least ``ceil(threshold * their number)``:
``licensed under cc by 4 0`` lacks one word of a template, but the one that matters.
The join:

* *order*: the templates' words by how many documents hold them, over the whole
  corpus; rarest first. Only those words can be common, so blocks are cut to them;
* *prefix filter*: a block that meets a template holds one of the template's
  first ``size - need + 1`` words, so whole documents without any are left out
  before their blocks are made, and those words are the join key;
* *length filter*: a block of fewer template words than needed is left out;
* *positional filter*: with the key at place p of the template and q of the
  block, at most ``1 + min(size - p, block size - q)`` words can be common
  (places from 1), if it is the first common one;
* *verification* on the sets, telling words included, once for each block and template.

Templates are a fixed, small table and are broadcast. Besides, base phrases are
found wherever their words stand consecutively.

Defined cases: a null text is empty and has no words, null first and last
places, empty labels and score 0; rows that repeat a doc_id are counted each and
share the labels that any of their texts earns;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening sentences of public licenses, as words.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
THRESHOLD = (4, 5)
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(text: Column) -> Column:
    """A-Z lower-cased; other letters may be too, but none becomes ASCII."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))


def _words(low: Column) -> Column:
    """Every word between two spaces of its own: ' w  w  w '; empty without words."""
    inner = F.trim(F.regexp_replace(low, _GAPS, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _spaced(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _count(words: Column, part: str) -> Column:
    return ((F.length(words) - F.length(F.replace(words, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("bigint")


def _words_in(part: Column) -> Column:
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def base_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels of ``docs`` (doc_id, words)."""
    words = F.col("words")
    firsts, lasts = [], []
    for phrase in BASE:
        part = _spaced(phrase)
        there = words.contains(part)
        firsts.append(F.when(there, _words_in(F.substring_index(words, part, 1))))
        lasts.append(F.when(there, _words_in(words) - len(phrase.split()) - _words_in(F.substring_index(words, part, -1))))
    labels = F.array_sort(F.array_compact(F.array(*(F.when(words.contains(_spaced(p)), F.lit(label)) for p, label in BASE.items()))))
    return docs.select(
        "doc_id",
        _words_in(words).alias("n_words"),
        sum((_count(words, _spaced(p)) for p in BASE), F.lit(0).cast("bigint")).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        labels.alias("base"),
    )


def template_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest first by documents of ``docs`` (words)."""
    vocabulary = sorted({w for t in templates for w in t.split()})
    own = F.array_intersect(F.split(F.trim("words"), "  "), F.array(*map(F.lit, vocabulary)))
    counts = {r.word: r.n for r in docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def telling_words(templates: dict[str, str]) -> dict[str, list[str]]:
    """Of each template, the words that no template of another label has."""
    return {t: sorted(set(t.split()).difference(*(o.split() for o, other in templates.items() if other != label))) for t, label in templates.items()}


def _needed(size: int, threshold: tuple[int, int]) -> int:
    return -(-size * threshold[0] // threshold[1])


def template_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, block, label, containment): every block of ``docs`` (doc_id, words) that meets a template."""
    templates = TEMPLATES if templates is None else templates
    order = template_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    index, keys, telling = [], set(), telling_words(templates)
    listed = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "cast(array() as array<string>)"
    for i, (text, label) in enumerate(templates.items()):
        tokens = sorted(set(text.split()), key=rank.get)
        needed, marks = _needed(len(tokens), threshold), telling[text]
        for p, token in enumerate(tokens[: len(tokens) - needed + 1], 1):
            keys.add(token)
            index.append(f"('{token}', {i}, '{label}', {p}, {len(tokens)}, {needed}, {listed(tokens)}, {_needed(len(marks), threshold)}, {listed(marks)})")
    spark = docs.sparkSession
    small = spark.sql(f"select * from values {', '.join(index)} as t(token, template, label, p, size, needed, tokens, telling, marks)")
    held = docs.where(F.col("words").rlike(" (?:" + "|".join(sorted(keys)) + ") "))
    longest = max((len(t.split()) for t in templates), default=1)
    runs = F.regexp_extract_all(F.concat("words", F.lit(" ")), F.lit(f"((?:[^ ]+ +){{1,{longest}}})"), F.lit(1))
    windows = F.zip_with(runs, F.slice(runs, 2, F.size(runs)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    blocks = held.select("doc_id", F.posexplode(windows).alias("block", "line"))
    # in the corpus's order: the vocabulary is listed in it, and an intersection keeps its first list's order
    own = F.array_intersect(F.array(*map(F.lit, order)), F.split(F.trim(F.regexp_replace("line", _GAPS, " ")), " "))
    blocks = blocks.select("doc_id", "block", own.alias("own")).where(F.size("own") >= min((int(x.split(", ")[5]) for x in index), default=0))
    probes = blocks.select("doc_id", "block", "own", F.posexplode("own").alias("q", "token")).where(F.col("token").isin(sorted(keys)))
    room = 1 + F.least(F.col("size") - F.col("p"), F.size("own") - F.col("q") - 1)
    candidates = probes.join(F.broadcast(small), "token").where((F.size("own") >= F.col("needed")) & (F.array_position("tokens", F.col("token")) == F.col("p")))
    first = F.array_intersect("own", "tokens")  # verified once: where the key is the first common word
    met = candidates.where((first[0] == F.col("token")) & (room >= F.col("needed"))).withColumn("common", F.size(first)).where("common >= needed")
    met = met.where(F.size(F.array_intersect("own", "marks")) >= F.col("telling"))
    return met.select("doc_id", "block", "label", (F.col("common") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): base places, labels and score."""
    low = docs.select("doc_id", _low(F.col("text")).alias("low"))
    read = low.select("doc_id", _words(F.col("low")).alias("words"))
    found = saved(template_matches(read, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")), "licenses")
    found = found.withColumnRenamed("doc_id", "found_id")
    out = base_phrases(read).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: base phrases and all templates."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    lists = {p: "[" + ", ".join(f"'{w}'" for w in p.split()) + "]" for p in BASE}
    places = {p: f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {x})" for p, x in lists.items()}
    every = " || ".join(f"[{{'at': i, 'label': '{label}'}} for i in {places[p]}]" for p, label in BASE.items())
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"
    telling, longest = telling_words(TEMPLATES), max(len(t.split()) for t in TEMPLATES)
    templates = ", ".join(f"({listed(sorted(set(t.split())))}, '{label}', {listed(telling[t])})" for t, label in TEMPLATES.items())
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {words.format("coalesce(text, '')")} as w from documents),
b as (select doc_id, len(w) as n_words, {every} as hits from d),
blocks as (select doc_id, list_distinct(w[k * {longest} + 1 : (k + 2) * {longest}]) as own from (select doc_id, w, unnest(range(0, (len(w) + {longest - 1}) // {longest})) as k from d)),
t as (select * from (values {templates}) as t(tokens, label, marks)),
m as (select doc_id, label, len(list_intersect(own, tokens)) as common, len(tokens) as size, len(list_intersect(own, marks)) as told, len(marks) as telling from blocks cross join t),
f as (select doc_id, list(distinct label) as found, max(common / size) as best from m where {THRESHOLD[1]} * common >= {THRESHOLD[0]} * size and {THRESHOLD[1]} * told >= {THRESHOLD[0]} * telling group by doc_id)
select b.doc_id, n_words::bigint as n_words, len(hits)::bigint as n_base,
  list_min([h.at for h in hits])::bigint as first_word, list_max([h.at for h in hits])::bigint as last_word,
  array_to_string(list_sort(list_distinct([h.label for h in hits])), ',') as base_labels,
  array_to_string(list_sort(list_distinct([h.label for h in hits] || coalesce(found, []))), ',') as labels,
  case when len(hits) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from b left join f on b.doc_id = f.doc_id
"""


OP9_SQL = _sql()
