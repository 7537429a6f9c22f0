"""Language ID: a byte convolutional network over fixed-length windows.

Bytes are embedded, filters of several widths run over them, each filter's
largest response in a window is kept, and a softmax layer reads those. The
network is trained in numpy on a bounded sample of labelled documents, about the
same number of each language. A text of any length is cut into windows of a
fixed number of bytes, all of them are scored, in batches of bounded size, and
the window probabilities are averaged by the bytes they cover.

Defined cases: ``und`` with score 0 for null and empty texts and those without a
letter, and for every text if there is nothing to learn from. Null languages are
not learned; a document with a null id is held out. Rows that repeat are scored
each on its own. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import held_out, id_and_text, prepared, share

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
PER_LANGUAGE = 800
MOST_LANGUAGES = 256
WINDOWS_PER_DOCUMENT = 4
EPOCHS = 6
BLOCK = 256


@dataclass
class Network:
    """Weights; a filter narrower than the widest has zeros where it ends."""

    languages: list[str]
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Responses of every filter at every position: windows x positions x filters."""
        rows, length = windows.shape
        widest = max(WIDTHS)
        embedded = self.embedding[windows].reshape(rows, length * EMBEDDED)
        spans = np.lib.stride_tricks.sliding_window_view(embedded, widest * EMBEDDED, axis=1)[:, ::EMBEDDED]
        return np.ascontiguousarray(spans).reshape(-1, widest * EMBEDDED) @ self.kernel

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for at in range(0, len(windows), BLOCK):
            part = windows[at:at + BLOCK]
            top = self.responses(part).reshape(len(part), -1, self.kernel.shape[1]).max(axis=1)
            logits = np.maximum(top + self.bias, 0) @ self.dense + self.offset
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            out[at:at + BLOCK] = e / e.sum(axis=1, keepdims=True)
        return out


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text; the last is filled with byte 0."""
    rows = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), dtype=np.uint8).reshape(rows, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy, a fixed number of passes."""
    random = np.random.default_rng(seed)
    widest, n_filters, classes = max(WIDTHS), len(WIDTHS) * FILTERS, len(languages)
    mask = np.zeros((widest * EMBEDDED, n_filters), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * EMBEDDED, k * FILTERS:(k + 1) * FILTERS] = 1
    weights = {
        "embedding": random.normal(0, 1, (256, EMBEDDED)),
        "kernel": random.normal(0, 0.25, (widest * EMBEDDED, n_filters)) * mask,
        "bias": np.zeros(n_filters), "dense": random.normal(0, 0.2, (n_filters, classes)), "offset": np.zeros(classes),
    }
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    positions = WINDOW - widest + 1
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows = order[at:at + 64]
            x, y = windows[rows], labels[rows]
            net = Network(languages, **weights)
            all_responses = net.responses(x).reshape(len(x), positions, n_filters)
            where = all_responses.argmax(axis=1)
            top = np.take_along_axis(all_responses, where[:, None], axis=1)[:, 0] + weights["bias"]
            hidden = np.maximum(top, 0)
            logits = hidden @ weights["dense"] + weights["offset"]
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ weights["dense"].T) * (top > 0)
            # each filter learns only from the span it responded to most
            taken = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(widest)]
            spans = weights["embedding"][taken].reshape(len(x), n_filters, -1)
            to_spans = (back[:, :, None] * weights["kernel"].T[None]).reshape(-1, EMBEDDED)
            embedding = np.zeros_like(weights["embedding"])
            np.add.at(embedding, taken.ravel(), to_spans)
            slope = {
                "embedding": embedding, "kernel": np.einsum("bfk,bf->kf", spans, back) * mask, "bias": back.sum(axis=0),
                "dense": hidden.T @ p, "offset": p.sum(axis=0),
            }
            step += 1
            for k, g in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[k] = (weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return Network(languages, **weights)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of about PER_LANGUAGE documents a language.

    Documents are drawn by their id alone, WINDOWS_PER_DOCUMENT windows of each,
    spread over its whole text.
    """
    known = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    ).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in sizes.collect()}
    languages = sorted(counts)
    if not languages:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), []
    part = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, PER_LANGUAGE / counts[lang]))])
    drawn = known.filter(share(F.col("doc_id"), "language sample") < part[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not any(map(str.isalpha, text)):
                    continue
                whole = windows_of(text.encode())
                at = np.unique(np.linspace(0, len(whole) - 1, WINDOWS_PER_DOCUMENT).astype(int))
                rows += [(lang, whole[k].tobytes()) for k in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "window"])

    rows = drawn.select("text", "lang").mapInArrow(cut, "lang string, window binary").orderBy("lang", "window").collect()
    number = {lang: k for k, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    return windows, np.array([number[r["lang"]] for r in rows], dtype=np.int64), languages


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the documents that are not held out."""
    prepared(docs.sparkSession)
    windows, labels, languages = sample(docs, id_col, text_col, lang_col)
    return train(windows, labels, languages) if len(windows) else None


def told(texts: list[str], network: Network | None) -> list[tuple[str, float]]:
    """Language and score of each text, windows of several texts in a batch."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    lettered = [k for k, t in enumerate(texts) if network is not None and any(map(str.isalpha, t))]
    group: list[tuple[int, int, np.ndarray]] = []

    def settle() -> None:
        p = network.probabilities(np.concatenate([w for *_, w in group]))
        at = 0
        for k, size, w in group:
            covered = np.full(len(w), WINDOW, dtype=np.float64)
            covered[-1] = size - WINDOW * (len(w) - 1)
            mean = covered @ p[at:at + len(w)] / size
            at += len(w)
            best = int(mean.argmax())
            out[k] = network.languages[best], float(min(1.0, max(0.0, mean[best])))
        group.clear()

    held = 0
    for k in lettered:
        raw = texts[k].encode()
        group.append((k, len(raw), windows_of(raw)))
        held += len(group[-1][2])
        if held >= 4 * BLOCK:
            settle()
            held = 0
    if group:
        settle()
    return out


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    prepared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = told(batch.column(2).to_pylist(), network)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return (
        id_and_text(docs, id_col, text_col)
        .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "text")
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
    )


def keep_identified(docs: DataFrame, least_score: float = 0.3, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is told with at least ``least_score``, with all their columns."""
    network = learn(docs, id_col, text_col, lang_col)
    place = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = told([t or "" for t in batch.column(place).to_pylist()], network)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in rows], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
