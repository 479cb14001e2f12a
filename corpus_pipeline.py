"""A corpus pipeline of four training-data operators over ``documents``.

Toxic documents go; one document of each group of near copies stays; documents
that hold a benchmark item go; the rest is packed into sequences. Every stage
works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecard.llm.common import forget, saved, table
from ratecard.llm.decontamination import decontaminate
from ratecard.llm.jaccard_join import jaccard_join, without_ids
from ratecard.llm.packing import pack_documents
from ratecard.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier finds toxic."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component; rows without a doc_id are kept."""
    gone = jaccard_join(docs).where(~F.col("kept")).select("doc_id").distinct()
    return without_ids(docs, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", ngram_jaccard_join), ("decontamination", decontamination), ("packing", packing)]

#: Tokenizers and edit distances within texts are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        if hasattr(before, "scratch"):
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
