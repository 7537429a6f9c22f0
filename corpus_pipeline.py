"""Corpus preparation: documents through the stages in order, each written and reread.

Every stage is a function of (spark, docs, sf_dir) that works on all its
predecessor kept and returns the columns of documents; the last returns the
encoded texts. Null texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayrunner.llm import bpe, exact_dedup, langid, minhash, mixing
from dayrunner.llm.common import table
from dayrunner.session import written


def identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or of no language that stands out, go."""
    return langid.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the document with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup over five-word shingles: one document of each group stays."""
    return minhash.keep_first(docs, words=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a sample raked to flattened source, language and topic shares."""
    return mixing.keep_sampled(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, n_tokens, ids."""
    return bpe.encode(docs)


STAGES = [
    ("language ID", identified_languages),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("byte BPE", encoded),
]

# Language ID is a trained model, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder first."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
