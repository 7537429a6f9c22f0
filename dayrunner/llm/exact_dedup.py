"""Exact dedup: immutable snapshots screen new batches by static binary-fuse filters.

Documents are taken in two batches in the order of their ids. The first is
grouped by digest and becomes the snapshot; its digests, dealt over hash
buckets, give one filter a bucket. The second batch is grouped on its own first,
so a text that makes up a third of it is one row from there on. The digests of
those groups are screened by the filters; what passes joins the exact buckets,
and the texts of both sides are compared before two groups become one.

Texts are equal when identical after each run of ASCII white space is one space.
Only digests are shuffled, but for the texts of the groups to be compared.
Within a batch, equality is that of SHA-256 together with the length.

Defined cases: null text is empty. Rows that repeat id and text are one
document. A null id counts as the largest; rows with it and one text are one
document. Equal ids with different texts are different documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrunner.llm import fuse
from dayrunner.llm.common import id_and_text, prepared, spare
from dayrunner.session import written

BUCKET_KEYS = 32_768
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id and text: doc_id, digest (SHA-256), size, rows."""
    norm = normalised(F.col("text"))
    return (
        id_and_text(docs, id_col, text_col)
        .select("doc_id", F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.length(norm).alias("size"))
        .groupBy("doc_id", "digest", "size").agg(F.count("*").alias("rows"))
    )


def _grouped(prints: DataFrame) -> DataFrame:
    return prints.groupBy("digest", "size").agg(F.min("doc_id").alias("first_id"), F.sum("rows").alias("rows"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def _keys(digests: pd.Series) -> np.ndarray:
    joined = b"".join(bytes(d[:8]) for d in digests)
    return np.frombuffer(joined, dtype="<u8")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One static filter a bucket of the snapshot's digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, cells = fuse.build(_keys(rows["digest"]))
        return pd.DataFrame([[key[0], seed, segment, segments, cells]], columns=["bucket", "seed", "segment", "segments", "cells"])

    return (
        _bucketed(snapshot, buckets).select("bucket", "digest").groupBy("bucket")
        .applyInPandas(build, "bucket int, seed int, segment int, segments int, cells binary")
    )


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The groups whose digest may be in the snapshot; a false one passes in 256."""

    def sift(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or held.empty:
            return rows.iloc[:0][["digest"]]
        f = held.iloc[0]
        found = fuse.contains(_keys(rows["digest"]), int(f.seed), int(f.segment), int(f.segments), f.cells)
        return rows.loc[found, ["digest"]]

    return (
        _bucketed(incoming, buckets).select("bucket", "digest").groupBy("bucket")
        .cogroup(filters.groupBy("bucket")).applyInPandas(sift, "digest binary")
    )


def _same_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose two texts are equal byte for byte: digest and both groups."""
    sides = pairs.select("digest", F.explode(F.array("old_id", "new_id")).alias("wanted"))
    texts = id_and_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    compared = (
        # The groups to compare grow with the corpus, so neither side is broadcast.
        texts.join(sides.hint("merge"), texts.doc_id.eqNullSafe(sides.wanted))
        .filter(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)) == F.col("digest"))
        .groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))
    )
    return pairs.join(compared.filter("same").select("digest"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The document with the smallest id of a group of equal texts is kept. An
    empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    prints = written(fingerprints(docs, id_col, text_col))
    middle = prints.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    old_side = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    prints = prints.withColumn("batch", F.when(old_side, 0).otherwise(1))
    old = written(_grouped(prints.filter("batch = 0")))
    new = written(_grouped(prints.filter("batch = 1")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, -(-old.count() // BUCKET_KEYS))
    filters = written(build_filters(old, buckets))
    passed = screen(new, filters, buckets)
    pairs = written(
        new.join(passed, "digest")
        .select("digest", "size", F.col("first_id").alias("new_id"), F.col("rows").alias("new_rows"))
        .join(old.select("digest", "size", F.col("first_id").alias("old_id"), F.col("rows").alias("old_rows")), ["digest", "size"])
    )
    same = written(_same_bytes(docs, pairs, id_col, text_col)).select("digest", "size", "old_id", "old_rows", "new_rows")
    by = ["digest", "size"]
    groups = old.join(same, by, "left").select(
        *by, F.lit(0).alias("batch"), F.col("first_id").alias("keep_id"),
        (F.col("rows") + F.coalesce("new_rows", F.lit(0))).alias("group_size"),
    ).unionByName(new.join(same, by, "left").select(
        *by, F.lit(1).alias("batch"), F.when(F.col("old_rows").isNotNull(), F.col("old_id")).otherwise(F.col("first_id")).alias("keep_id"),
        (F.col("rows") + F.coalesce("old_rows", F.lit(0))).alias("group_size"),
    ))
    return prints.drop("rows").join(groups, [*by, "batch"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns, one row each."""
    names = [spare(docs, n) for n in ("_kept_id", "_kept_digest", "_digest", "_copy")]
    kept_id, kept_digest, own_digest, copy = names
    chosen = exact_dedup(docs, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_digest))
    digest = F.unhex(F.sha2(normalised(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256))
    marked = docs.withColumn(own_digest, digest)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest))
    # Copies that repeat id and text lie side by side after the join already.
    order = Window.partitionBy(kept_digest, kept_id).orderBy(F.lit(1))
    return marked.join(chosen.hint("merge"), same).withColumn(copy, F.row_number().over(order)) \
        .filter(F.col(copy) == 1).select(*docs.columns)
