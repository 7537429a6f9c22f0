"""Near-duplicate documents: universal hash minima, bands, verified links, components.

A document's set is its distinct word shingles. 160 universal hash minima are cut
into 32 bands of 5: two sets with Jaccard similarity 0.8 share no band with a
probability of 3 in a million, more similar ones far less often. Equal sets are
one class from the start. Classes that share a band are a bucket:

1. each member is linked to the least member of its bucket;
2. components of the confirmed links are formed; in buckets that hold several,
   each member is linked to a member picked for that bucket at random, so that a
   text far from one member of its group still meets many others;
3. in buckets that hold several components after that, members outside the least
   member's component are held against all members of other components. So no
   candidate pair is left out, and pairs inside a component are never listed.
   Here the full sets are compared inside the join, so that of a large group that
   is alike below the similarity no pair is listed.

A candidate must first agree in its signature (two bits of each minimum; a pair
of similarity 0.8 fails once in some 10^8) and in set size. Links are confirmed
on the full sets of 64-bit shingle hashes.

Defined cases: null and empty texts have an empty set and no links. Rows that
repeat an id share its node. Rows with a null id have no links and a null
component, and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import id_and_text, prepared
from dayrunner.llm.components import components
from dayrunner.session import written

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
# Differing bits allowed of 320. Similarity 0.8 leaves 32 on average, with a
# standard deviation of 6.5.
MOST_BITS = 72
BLOCK = 2048
_seeded = np.random.default_rng(20_240_607)
MULTIPLIERS = _seeded.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _seeded.integers(0, 2**64, HASHES, dtype=np.uint64)
BAND_FACTORS = _seeded.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
BAND_SALTS = _seeded.integers(0, 2**64, BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs other than ASCII white space, A-Z lower-cased; with fewer
    words than a shingle takes, the whole sequence is the only one.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(words, len(h))
    rolled = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - width + 1 + k])
    return np.unique(rolled)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each universal hash (multiply, add, take the high half)."""
    least = np.full(HASHES, np.uint64(2**32 - 1))
    low = hashes & np.uint64(0xFFFFFFFF)
    for at in range(0, len(low), BLOCK):
        values = (MULTIPLIERS[:, None] * low[None, at:at + BLOCK] + OFFSETS[:, None]) >> np.uint64(32)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = BAND_SALTS.copy()
    for row, factor in zip(least.reshape(BANDS, ROWS).T, BAND_FACTORS, strict=True):
        keys = _mixed(keys ^ (row * factor))
    return keys.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, packed into five 64-bit words."""
    scrambled = _mixed(least + np.uint64(0x9E3779B97F4A7C15))
    bits = np.concatenate([scrambled & np.uint64(1), (scrambled >> np.uint64(1)) & np.uint64(1)]).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>, bits array<long>"


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, set_hash, bands, bits (null if empty)."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()),
        ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text, words)
                if not len(found):
                    rows.append((doc_id, 0, None, None, None))
                    continue
                least = minima(found)
                rows.append((doc_id, len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(least), signature(least)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(sign, SIGNED)


def _sets(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its full set, for the documents in ``nodes`` alone."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    return (
        # The nodes grow with the corpus, so they are never broadcast.
        id_and_text(docs, id_col, text_col).join(nodes.hint("merge"), "doc_id", "left_semi")
        .mapInArrow(hashed, "doc_id long, hashes array<long>")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return (
        pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").withColumn("shared", shared)
        .filter(100 * F.col("shared") >= percent * union).select("a", "b")
    )


def _alike(percent: int) -> Column:
    """The signatures of x and y agree and their set sizes allow the similarity."""
    differing = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(5)), F.lit(0))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    return (differing <= MOST_BITS) & (100 * small >= percent * large)


def near_dedup(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links.

    ``component_id`` is the least id reachable over links of ``percent`` or more;
    the document with that id is kept. ``n_links`` counts the confirmed links of
    the document's class that held components together. An empty table gives no
    rows.
    """
    prepared(docs.sparkSession)
    signed = written(signatures(docs, words, id_col, text_col))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    member = full.select("doc_id", "set_hash").join(classes, "set_hash").select("doc_id", "node").distinct()
    # Ids that stand for a class; the signature comes with the class's own row.
    heads = written(
        full.join(classes.hint("merge"), "set_hash").filter("doc_id = node").dropDuplicates(["doc_id", "set_hash"])
        .select("node", F.col("n_shingles").alias("n"), "bands", *[F.col("bits")[k].alias(f"s{k}") for k in range(5)])
    )
    banded = heads.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lead")).filter("size > 1")
    members = written(banded.join(buckets.hint("merge"), "key"))
    brief = heads.drop("bands")
    sets = written(_sets(docs, members.select(F.col("node").alias("doc_id")).distinct(), words, id_col, text_col))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) that agree in signature and size, held against their full sets."""
        x, y = brief.alias("x"), brief.alias("y")
        alike = (
            pairs.distinct().join(y.hint("merge"), F.col("b") == F.col("y.node"))
            .join(x.hint("merge"), F.col("a") == F.col("x.node")).filter(_alike(percent)).select("a", "b")
        )
        return written(_confirmed(alike, sets, percent))

    def labelled(names: DataFrame) -> DataFrame:
        """Members of the larger buckets with their component ``c``."""
        found = members.filter("size > 2").join(names.select("node", F.col("component").alias("c")).hint("merge"), "node", "left")
        return found.withColumn("c", F.coalesce("c", "node"))

    linked = confirmed(members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))
    wide = written(labelled(written(components(linked))))
    chance = F.struct(F.xxhash64("node", "key").alias("draw"), "node", "c")
    picked = wide.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(chance).alias("pick")).filter("c1 <> c2")
    again = wide.join(picked, "key").filter(F.col("c") != F.col("pick.c")) \
        .select(F.least("node", "pick.node").alias("a"), F.greatest("node", "pick.node").alias("b"))
    linked = linked.unionByName(confirmed(again))

    wide = written(labelled(written(components(linked))))
    mixed = (
        wide.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(F.struct("node", "c"))["c"].alias("lead_c"))
        .filter("c1 <> c2").select("key", "lead_c")
    )
    open_members = written(
        wide.join(mixed, "key").join(heads, "node").join(sets.withColumnRenamed("doc_id", "node").hint("merge"), "node"))
    x, y = open_members.filter("c <> lead_c").alias("x"), open_members.alias("y")
    apart = (F.col("x.c") != F.col("y.c")) & (F.col("y.node") != F.col("y.lead")) \
        & ((F.col("y.c") == F.col("y.lead_c")) | (F.col("x.node") < F.col("y.node")))
    # A pair that shares several buckets is compared in one of them.
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")
    shared = F.size(F.array_intersect("x.hashes", "y.hashes"))
    linked_sets = (100 + percent) * shared >= percent * (F.size("x.hashes") + F.size("y.hashes"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _alike(percent) & once & linked_sets) \
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    linked = linked.unionByName(rest.distinct())

    # An id that repeats with different texts belongs to several classes.
    linked = written(linked.unionByName(member.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")))
    ends = written(components(linked))
    degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = ends.join(degree, "node").select(F.col("node").alias("doc_id"), "component", "n_links")
    return signed.select("doc_id", "n_shingles").join(found.hint("merge"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns."""
    dropped = near_dedup(docs, words, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped.hint("merge"), docs[id_col] == dropped["_dropped"], "left_anti")
