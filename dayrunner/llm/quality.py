"""Quality: a text is scored by which of two zstandard dictionaries shrinks it more.

One dictionary is built from good and one from bad labelled text, both from
bounded samples. A text is cut into blocks of a fixed size, every block is
compressed with either dictionary, and the difference of the summed sizes over
the text's length is the feature. A logistic curve, fitted on labelled documents
that didn't go into the dictionaries, turns it into a probability.

Only documents whose crc32 remainder isn't 2 are learned from. Defined cases: a
null text is empty; its feature is that of equal sizes, zero. A document with
several labels counts with the lowest; null labels are not learned. Without
labels of both kinds the score is the share of good labels, and 0.5 without any.
Rows that repeat are scored each on its own. A document with a null id is held
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import held_out, id_and_text, prepared, share

BLOCK = 512
LEVEL = 3
PER_LABEL = 1_200
BLOCKS_PER_DOCUMENT = 6
DICTIONARY_BYTES = 65_536
CALIBRATION_DOCUMENTS = 4_000
CUT = 0.7


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve; empty dictionaries leave the offset alone."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def score(self, feature: float) -> float:
        z = min(500.0, max(-500.0, self.slope * feature + self.offset))
        return float(1 / (1 + np.exp(-z)))


def blocks_of(raw: bytes) -> list[bytes]:
    return [raw[at:at + BLOCK] for at in range(0, len(raw), BLOCK)] or [b""]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held)


def feature(text: str, good: bytes, bad: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / length, over all blocks."""
    if not text or not good or not bad:
        return 0.0
    raw = text.encode()
    parts = blocks_of(raw)
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    return sum(len(by_bad(p)) - len(by_good(p)) for p in parts) / len(raw)


def build_dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; of few blocks, their bytes as they are."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 8)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def fit_curve(features: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a slight penalty."""
    centre, spread = features.mean(), max(float(features.std()), 1e-9)
    x = np.stack([(features - centre) / spread, np.ones(len(features))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - 0.01 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality",
) -> Model:
    """Dictionaries and curve from at most about 2 x PER_LABEL + CALIBRATION_DOCUMENTS documents."""
    prepared(docs.sparkSession)
    known = (
        labels.select(labels[label_id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        rate = (counts.get(1, 0) + 0.5 * (not total)) / max(total, 1)
        rate = min(0.999, max(0.001, rate))
        return Model(b"", b"", 0.0, float(np.log(rate / (1 - rate))))
    # Half of the ids may go into dictionaries, the other half into the curve.
    half = share(F.col("doc_id"), "quality half") < 0.5
    draw = share(F.col("doc_id"), "quality sample")
    rate = F.when(F.col("label") == 1, min(1.0, 2 * PER_LABEL / counts[1])).otherwise(min(1.0, 2 * PER_LABEL / counts[0]))
    chosen = known.withColumn("use", F.when(half, "dictionary").otherwise("curve")).filter(
        (half & (draw < rate)) | (~half & (draw < min(1.0, 2 * CALIBRATION_DOCUMENTS / total))))
    # A few thousand ids, whatever the number of labels.
    drawn = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = blocks_of(text.encode())
                at = np.unique(np.linspace(0, len(parts) - 1, BLOCKS_PER_DOCUMENT).astype(int))
                rows += [(label, parts[k]) for k in at if parts[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "part"])

    parts = drawn.filter("use = 'dictionary'").select("text", "label").mapInArrow(cut, "label int, part binary") \
        .orderBy("label", "part").collect()
    good, bad = (build_dictionary([bytes(r["part"]) for r in parts if r["label"] == k]) for k in (1, 0))
    if not good or not bad:
        rate = counts[1] / total
        return Model(b"", b"", 0.0, float(np.log(rate / (1 - rate))))
    curve = _features(drawn.filter("use = 'curve'").select("doc_id", "label", "text"), Model(good, bad)) \
        .orderBy("doc_id", "feature").collect()
    if len({r["label"] for r in curve}) < 2:
        return Model(good, bad, 1.0, float(np.log(counts[1] / counts[0])))
    slope, offset = fit_curve(np.array([r["feature"] for r in curve]), np.array([r["label"] for r in curve], dtype=float))
    return Model(good, bad, slope, offset)


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, the second column as it is, and the feature of the third, the text."""
    kept = rows.columns[1]
    good, bad = model.good, model.bad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [feature(t, good, bad) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["doc_id", kept, "feature"])

    return rows.mapInArrow(run, f"doc_id long, {kept} {dict(rows.dtypes)[kept]}, feature double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from CUT up), feature."""
    prepared(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("feature") * model.slope + model.offset))
    return _features(rows, model).withColumn("score", 1 / (1 + F.exp(-z))).select(
        "doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "feature")
