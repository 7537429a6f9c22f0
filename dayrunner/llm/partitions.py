"""Nearest neighbours over learned partitions of a neighbour graph.

On a bounded sample of the vectors a graph of nearest neighbours is built and cut
into parts of nearly equal size with few edges between them. A small network
learns to tell the part (and those of a vector's neighbours) from the vector. It
then places every row of the index, and sends a query to its most probable parts,
as many as the sample needed for the wished recall. Within those, all rows are
compared exactly.

A part of any size is dealt out in blocks of rows, and its queries in blocks of
queries, so that a part that holds a third of all rows is many small tasks.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most, take no part; neither do rows with a null id.
Rows that repeat an id are candidates each, but never of a query with that id;
such queries are asked once. Queries with fewer candidates than wished get all
of them. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayrunner.llm.common import prepared, share
from dayrunner.session import written

SAMPLE = 8_192
GRAPH_DEGREE = 10
ROWS_A_PART = 128
MOST_PARTS = 64
HIDDEN = 128
EPOCHS = 12
BALANCE = 1.1
RECALL = 0.96
BASE_BLOCK = 4_096
QUERY_BLOCK = 512


def nearest(queries: np.ndarray, base: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Numbers of the k nearest rows of ``base``, in blocks of queries."""
    out = np.empty((len(queries), k), dtype=np.int64)
    norms = (base**2).sum(axis=1)
    for at in range(0, len(queries), 512):
        d = norms - 2 * queries[at:at + 512] @ base.T
        if skip_self:
            rows = np.arange(len(d))
            d[rows, at + rows] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """Part of every vector: grown around seeds within a size limit, then moved along the graph to cut fewer edges."""
    n = len(vectors)
    limit = int(np.ceil(BALANCE * n / parts))
    centres = vectors[random.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        d = (centres**2).sum(axis=1) - 2 * vectors @ centres.T
        order = np.argsort(d, axis=1)
        gain = np.take_along_axis(d, order[:, :2], axis=1)
        held = np.zeros(parts, dtype=np.int64)
        # those with most to lose choose first
        for row in np.argsort(gain[:, 0] - gain[:, 1]):
            for p in order[row]:
                if held[p] < limit:
                    part[row] = p
                    held[p] += 1
                    break
        for p in range(parts):
            if held[p]:
                centres[p] = vectors[part == p].mean(axis=0)
    both = [[] for _ in range(n)]
    for a, near in enumerate(graph):
        for b in near:
            both[a].append(b)
            both[b].append(a)
    for _ in range(4):
        for a in random.permutation(n):
            votes = np.bincount(part[both[a]], minlength=parts)
            best = int(np.where(held < limit, votes, -1).argmax())
            if votes[best] > votes[part[a]]:
                held[part[a]] -= 1
                held[best] += 1
                part[a] = best
    return part


@dataclass
class Router:
    """Network from a vector to the probability of each part, and how many parts a query visits."""

    mean: np.ndarray
    scale: float
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.mean) * self.scale
        return np.maximum(x @ self.hidden + self.bias, 0) @ self.out + self.offset

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")


def _trained(vectors: np.ndarray, targets: np.ndarray, random: np.random.Generator) -> Router:
    n, width = vectors.shape
    mean = vectors.mean(axis=0)
    scale = 1 / max(float(np.sqrt(((vectors - mean)**2).mean())), 1e-12)
    w = {
        "hidden": random.normal(0, np.sqrt(2 / width), (width, HIDDEN)), "bias": np.zeros(HIDDEN),
        "out": random.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, targets.shape[1])), "offset": np.zeros(targets.shape[1]),
    }
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    x_all, step = (vectors - mean) * scale, 0
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for at in range(0, n, 128):
            x, y = x_all[order[at:at + 128]], targets[order[at:at + 128]]
            h = np.maximum(x @ w["hidden"] + w["bias"], 0)
            z = h @ w["out"] + w["offset"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - y) / len(x)
            back = (g @ w["out"].T) * (h > 0)
            slope = {"hidden": x.T @ back, "bias": back.sum(axis=0), "out": h.T @ g, "offset": g.sum(axis=0)}
            step += 1
            for k, s in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * s
                second[k] = 0.999 * second[k] + 0.001 * s * s
                w[k] -= 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Router(mean, scale, w["hidden"], w["bias"], w["out"], w["offset"], targets.shape[1])


def fit(vectors: np.ndarray, recall: float = RECALL, seed: int = 11) -> Router:
    """A router fitted on a sample of vectors (rows in a fixed order)."""
    random = np.random.default_rng(seed)
    n = len(vectors)
    parts = max(1, min(MOST_PARTS, n // ROWS_A_PART))
    degree = min(GRAPH_DEGREE, n - 1)
    if parts == 1 or degree < 1:
        width = vectors.shape[1] if n else 1
        return Router(np.zeros(width), 1.0, np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1), 1)
    graph = nearest(vectors, vectors, degree, skip_self=True)
    part = balanced_parts(vectors, graph, parts, random)
    targets = np.zeros((n, parts))
    np.add.at(targets, (np.repeat(np.arange(n), degree), part[graph].ravel()), 0.5 / degree)
    targets[np.arange(n), part] += 0.5
    # A first router, trained without a quarter of the sample, tells how many
    # parts that quarter has to visit.
    aside = random.random(n) < 0.25
    trial = _trained(vectors[~aside], targets[~aside], random)
    ranks = np.argsort(trial.ranked(vectors), axis=1)
    place = ranks[:, :].copy()
    home = trial.ranked(vectors)[:, 0]
    asked = np.flatnonzero(aside)
    need = place[asked[:, None], home[graph[asked]]]
    found = np.array([(need < m).mean() for m in range(1, parts + 1)])
    router = _trained(vectors, targets, random)
    router.probes = int(np.argmax(found >= recall)) + 1 if (found >= recall).any() else parts
    return router


def _usable(vec: Column) -> Column:
    whole = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    vectors = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vec_col].cast("array<double>").alias("vec")) \
        .filter(F.col("vec_id").isNotNull()).filter(_usable(F.col("vec")))
    widths = vectors.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return vectors.filter(F.size("vec") == (widths["width"] if widths else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(
    rows: DataFrame, is_query: Column | None = None, k: int = 10, sample: int = SAMPLE, recall: float = RECALL,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on vec_id (every hundredth, if not given). The
    score is the Euclidean distance in double precision.
    """
    prepared(rows.sparkSession)
    base = written(usable_vectors(rows, id_col, vec_col))
    total = base.count()
    drawn = base.withColumn("draw", share(F.col("vec_id"), "index sample")).filter(F.col("draw") < min(1.0, sample / max(total, 1)))
    drawn = drawn.orderBy("draw", "vec_id").limit(sample).collect()
    vectors = np.array([r["vec"] for r in drawn]) if drawn else np.empty((0, 1))
    router, width = fit(vectors, recall), vectors.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.ranked(_matrix(batch.column(1), width))[:, 0] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["vec_id", "vec", "part"])

    placed = written(base.mapInArrow(place, "vec_id long, vec array<double>, part int"))
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    asked = placed.filter(is_query if is_query is not None else F.col("vec_id") % 100 == 0)
    asked = asked.groupBy("vec_id").agg(F.min("vec").alias("vec"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([held.get(p, 0) for p in range(router.out.shape[1])])
        for batch in batches:
            order = router.ranked(_matrix(batch.column(1), width)) if batch.num_rows else np.empty((0, 1), dtype=np.int64)
            # enough parts for the recall, and for k candidates besides the query's own rows
            seen = np.cumsum(sizes[order], axis=1) - sizes[order]
            visits = (np.arange(order.shape[1]) < router.probes) | (seen <= 4 * k)
            parts = [o[v].tolist() for o, v in zip(order, visits, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=["vec_id", "vec", "parts"])

    routed = asked.mapInArrow(send, "vec_id long, vec array<double>, parts array<int>") \
        .select("vec_id", "vec", F.explode("parts").alias("part"))
    routed = written(routed)
    waiting = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    if not waiting:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def blocks(sizes: dict[int, int], each: int) -> Column:
        pairs = [F.lit(v) for p, n in sorted(sizes.items()) for v in (p, -(-n // each))]
        return F.coalesce(F.create_map(*pairs)[F.col("part")], F.lit(1))

    base_blocks, query_blocks = blocks(held, BASE_BLOCK), blocks(waiting, QUERY_BLOCK)
    dealt = ["part", "base_block", "query_block"]
    held_rows = placed.withColumn("base_block", F.pmod(F.xxhash64("vec_id"), base_blocks).cast("int")) \
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    sent_rows = routed.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), query_blocks).cast("int")) \
        .withColumn("base_block", F.explode(F.sequence(F.lit(0), base_blocks - 1)))

    def compare(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(candidates):
            ids = candidates["vec_id"].to_numpy()
            points = np.stack(candidates["vec"].to_list())
            for query_id, vec in zip(queries["vec_id"], queries["vec"], strict=True):
                d = np.sqrt(((points - vec)**2).sum(axis=1))
                d[ids == query_id] = np.inf
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out["query_id"] += [query_id] * len(near)
                out["vec_id"] += ids[near].tolist()
                out["score"] += d[near].tolist()
        return pd.DataFrame(out)

    found = (
        sent_rows.groupBy(*dealt).cogroup(held_rows.groupBy(*dealt))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
