"""Fill-in-middle transformation: texts cut in three and put in another order.

A text's units are runs of the letters A to Z of either case, and every other
code point. An Arrow-batched pandas UDF notes where each unit ends in a compact
array; two look-ups in it slice the text. The cuts, and whether and how a text
is arranged, follow from a digest of its doc_id, so a lost task gives the same
again. Nothing is shuffled, and one text is held at a time beside its batch,
whose bytes Spark bounds.

=====  ==============================================
form   output
=====  ==============================================
plain  the text
psm    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
spm    ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
=====  ==============================================

``restore`` rebuilds a text from output and form alone: a text with a mark in it
is never arranged, and no mark can begin inside another, so each is found by its
first place.

Defined cases: null and empty texts, and those that hold a mark, are plain; a
null doc_id has the seed of the bare prefix; repeated rows come out alike, each;
an empty table gives no rows; further columns, also of the names of new ones,
are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Before the doc_id in what the digest is taken of; of 100 texts, how many are arranged, and of 100 arranged how many as spm.
SEED, ARRANGED, SPM = "1:", 90, 20
ARRANGEMENT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit of ``text`` ends, four bytes a unit."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def arrange_text(doc_id: str, text: str, seed: str = SEED, arranged: int = ARRANGED, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle, and output of one text."""
    ends = unit_ends(text)
    h = digest(seed + doc_id)
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= arranged or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return len(ends), "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return len(ends), "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore_text(output: str, form: str) -> str:
    """The text of which ``arrange_text`` made ``output``."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def arrangement(seed: str, arranged: int, spm: int):
    """The pandas UDF (doc_id as text, text) -> ``ARRANGEMENT``."""

    @F.pandas_udf(ARRANGEMENT)
    def arrange(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [(*x, digest(x[-1])) for x in (arrange_text(i, t, seed, arranged, spm) for i, t in zip(ids, texts))]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ARRANGEMENT.split(", ")])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return arrange


@F.pandas_udf(StringType())
def restored(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([restore_text(o, f) for o, f in zip(outputs, forms)], dtype=object)


@F.pandas_udf(StringType())
def sha256_of(texts: pd.Series) -> pd.Series:
    return pd.Series([digest(t) for t in texts], dtype=object)


def fill_in_middle(docs: DataFrame, seed: str = SEED, arranged: int = ARRANGED, spm: int = SPM) -> DataFrame:
    """doc_id and ``ARRANGEMENT`` of each of ``docs`` (doc_id, text)."""
    doc_id = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), arrangement(seed, arranged, spm)(doc_id, text).alias("made"))
    return made.select("doc_id", "made.*")


def restore(arranged: DataFrame) -> DataFrame:
    """``arranged`` (output, form) with its ``text`` rebuilt."""
    return arranged.withColumn("text", restored("output", "form"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` arranged, and the digests of what is rebuilt from that."""
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", sha256_of("text").alias("restored_sha256"))


OP11_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('{SEED}' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select doc_id, t, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
f as (select *, case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {ARRANGED} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form,
  least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high from s),
c as (select *, array_to_string(u[1:low], '') as p, array_to_string(u[low + 1:high], '') as m, array_to_string(u[high + 1:], '') as x from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || x || '{MIDDLE}' || m else '{SUFFIX}' || x || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256,
  sha256(case form when 'plain' then t else p || m || x end) as restored_sha256
from c
"""
