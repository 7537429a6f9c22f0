"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, one for each bit prefix; every decision has a
context tree over the ``depth`` bytes before it. A node estimates its bits by
Krichevsky-Trofimov; its weighted probability is half its own estimate and half
the product of its children's, so all depths are mixed by how well they did. The
probability of a byte is the product of its eight bits', and a text's score the
log10 probability of its bytes and of its end. Texts are lower-cased (A-Z).

How it runs: documents are dealt into blocks of bounded bytes, and a block's
distinct (context, byte) pairs and distinct words become rows. A shuffle adds up
their training counts over the corpus. The trees below two bytes of context are
solved where those contexts' rows meet; the nodes above, 256 x 255 at most, are
merged from them and sent to all. Each distinct pair gets its log probability,
each distinct word its count; both are joined back to the blocks that hold
them, and a block's texts are read after its own table. So nothing that grows
with the corpus is broadcast, and text moves once.

Defined cases: null text is empty and has its end alone. A null id is held out.
Rows that repeat are learned and scored each. Very long texts are scored whole;
a block holds one at least. Without training documents every bit has
probability one half, and the base score that of an empty count. An empty table
gives an empty table. Further columns of ``docs`` are not read, whatever their
names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import id_and_text, prepared_for_rows
from dayrunner.session import written

DEPTH = 4
END = b"\xff"  # no byte of UTF-8; stands for the end of a text, and for what is before it
BLOCK_BYTES = 24_000_000
PART_BYTES = 1 << 20
PART_TEXTS = 4_096
PACK_LEVEL = 3
SOLVED_ROWS = 1 << 20
TOP_BYTES = 2
LOG_HALF = np.log(0.5)

DEALT = "block long, blob binary, pair long, word binary, n long"
KINDS = {"block": pa.int64(), "blob": pa.binary(), "pair": pa.int64(), "word": pa.binary(), "n": pa.int64()}


# --- pairs of context and byte ------------------------------------------------

def pairs_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of all texts and their ends: the bytes before, nearest first, and
    the byte itself, as one number; and where each text's numbers start."""
    data = np.frombuffer(END * depth + (END * depth).join(texts) + END, np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = depth + np.concatenate([[0], np.cumsum(sizes[:-1] + depth - 1)]).astype(np.int64)
    wanted = np.repeat(at - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    pair = np.zeros(len(data) - depth, np.int64)
    for back in range(1, depth + 1):
        pair = pair << 8 | data[depth - back:len(data) - back]
    return (pair << 8 | data[depth:])[wanted - depth], np.cumsum(sizes) - sizes


class Block:
    """Distinct pairs and words of the texts of one block, with their training counts."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.size = number, depth, 0
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words: Counter[bytes] = Counter()

    def rows(self, many: int, **columns: pa.Array) -> pa.RecordBatch:
        full = {"block": pa.array(np.full(many, self.number)), **columns}
        return pa.RecordBatch.from_arrays([full.get(name, pa.nulls(many, kind)) for name, kind in KINDS.items()], names=list(KINDS))

    def bundle(self, ids: list, learned: list[bool], raw: list[bytes]) -> pa.RecordBatch:
        """Count these texts; they go on as one packed row."""
        for taught in (True, False):
            texts = [t for t, is_taught in zip(raw, learned, strict=True) if is_taught is taught]
            if texts:
                found, times = np.unique(pairs_of(texts, self.depth)[0], return_counts=True)
                self.pairs, self.counts = added(self.pairs, self.counts, found, times if taught else times * 0)
                tokens = b" ".join(texts).split()
                if taught:
                    self.words.update(tokens)
                else:
                    for w in set(tokens):
                        self.words.setdefault(w, 0)
        self.size += sum(map(len, raw))
        return self.rows(1, n=pa.array([sum(learned)], pa.int64()), blob=pa.array([packed(ids, learned, raw)], pa.binary()))

    def table(self) -> Iterator[pa.RecordBatch]:
        yield self.rows(len(self.pairs), pair=pa.array(self.pairs), n=pa.array(self.counts))
        yield self.rows(len(self.words), word=pa.array(list(self.words), pa.binary()), n=pa.array(list(self.words.values()), pa.int64()))


def packed(ids: list, learned: list[bool], raw: list[bytes]) -> bytes:
    """Documents as one compressed value: their number, then sizes, ids, whether there is an id, whether learned, then the texts."""
    numbers = [[len(t) for t in raw], [i or 0 for i in ids], [i is not None for i in ids], learned]
    head = np.array([len(raw), *chain.from_iterable(numbers)], np.int64)
    return zstandard.ZstdCompressor(level=PACK_LEVEL).compress(head.tobytes() + b"".join(raw))


def unpacked(blob: bytes) -> tuple[list, list[bool], list[bytes]]:
    """ids, learned and texts of a packed value."""
    whole = zstandard.ZstdDecompressor().decompress(blob)
    many = int(np.frombuffer(whole, np.int64, 1)[0])
    sizes, ids, present, learned = np.frombuffer(whole, np.int64, 4 * many, 8).reshape(4, many).tolist()
    at = [8 * (4 * many + 1) + size for size in accumulate(sizes, initial=0)]
    return [i if p else None for i, p in zip(ids, present, strict=True)], [x == 1 for x in learned], [whole[a:b] for a, b in pairwise(at)]


def dealt(docs: DataFrame, depth: int, rest: int, modulo: int) -> DataFrame:
    """A written table: packed texts with their block, and each block's distinct pairs and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(TaskContext.get().partitionId() << 32, depth)
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for i, taught, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode().lower()
                for column, value in zip(held, (i, taught, raw), strict=True):
                    column.append(value)
                size += len(raw)
                if size >= PART_BYTES or len(held[0]) >= PART_TEXTS:
                    yield block.bundle(*held)
                    held, size = ([], [], []), 0
                    if block.size >= BLOCK_BYTES:
                        yield from block.table()
                        block = Block(block.number + 1, depth)
        if held[0]:
            yield block.bundle(*held)
        yield from block.table()

    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulo != rest, F.lit(False))
    return written(docs.select("doc_id", learned.alias("learned"), "text").mapInArrow(run, DEALT))


def added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of both sides with their summed counts."""
    both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([counts, times]), len(both)).astype(np.int64)


# --- the trees -----------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    steps = sum(np.log(x + k) for k in range(8))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - steps


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov: log probability of a sequence with these counts of bits."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return LOG_HALF + np.logaddexp(own, below)


def share_of_own(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


@dataclass
class Level:
    """Nodes of one depth for one bit: distinct ids, each row's node, counts, log probabilities."""

    ids: np.ndarray
    at: np.ndarray
    first: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    below: np.ndarray | None = None

    @property
    def whole(self) -> np.ndarray:
        return self.own if self.below is None else weighted(self.own, self.below)

    def next_bit(self, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of each row's bit, given that of the level below."""
        zeros, ones = self.zeros[self.at], self.ones[self.at]
        p = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
        if deeper is None:
            return p
        own = share_of_own(self.own, self.below)[self.at]
        return own * p + (1 - own) * deeper


def solved(pair: np.ndarray, n: np.ndarray, depth: int, bit: int) -> list[Level]:
    """Levels from ``depth`` up to TOP_BYTES of context for the bit-th bit of the byte.
    The rows hold whole subtrees of contexts of TOP_BYTES."""
    value = pair >> (7 - bit) & 1
    node = 1 << bit | (pair & 255) >> (8 - bit)
    levels: list[Level] = []
    for d in range(depth, TOP_BYTES - 1, -1):
        ids, first, at = np.unique((pair >> 8 * (depth + 1 - d)) << 8 | node, return_index=True, return_inverse=True)
        ones = np.bincount(at, n * value, len(ids))
        zeros = np.bincount(at, n * (1 - value), len(ids))
        below = np.bincount(at[levels[-1].first], levels[-1].whole, len(ids)) if levels else None
        levels.append(Level(ids, at, first, zeros, ones, log_estimate(zeros, ones), below))
    return levels


def subtrees(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of whole subtrees, about SOLVED_ROWS at a time, from rows sorted by pair."""
    shift = 8 * (depth + 1 - TOP_BYTES)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        pair, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if size >= SOLVED_ROWS:
            cut = int(np.searchsorted(pair >> shift, held[-1][0][-1] >> shift, side="right"))
            if cut < len(pair):
                held.append((pair[:cut], n[:cut]))
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, size, pair, n = [], 0, pair[cut:], n[cut:]
        held.append((pair, n))
        size += len(pair)
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


@dataclass(frozen=True)
class Top:
    """Nodes of less than TOP_BYTES of context: [byte, node] and [node]."""

    zeros: np.ndarray = field(default_factory=lambda: np.zeros((256, 256)))
    ones: np.ndarray = field(default_factory=lambda: np.zeros((256, 256)))
    below: np.ndarray = field(default_factory=lambda: np.zeros((256, 256)))

    def mix(self, near: np.ndarray, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of each row's bit at the root."""
        whole = weighted(log_estimate(self.zeros, self.ones), self.below)
        for zeros, ones, below, at in ((self.zeros, self.ones, self.below, (near, node)),
                                       (self.zeros.sum(0), self.ones.sum(0), whole.sum(0), (node,))):
            own = share_of_own(log_estimate(zeros, ones), below)[at]
            zeros, ones = zeros[at], ones[at]
            deeper = own * (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1) + (1 - own) * deeper
        return deeper


def probabilities(pairs: DataFrame, depth: int) -> DataFrame:
    """pair, log_p: log10 probability of each pair's byte after its context, from all counts."""
    shift = 8 * (depth + 1 - TOP_BYTES)
    # At most 2^(8 (depth - 1)) rows meet in one subtree, however large the corpus is.
    rows = pairs.select("pair", "n").repartition(F.shiftrightunsigned("pair", shift)).sortWithinPartitions("pair")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, n in subtrees(batches, depth):
            for bit in range(8):
                level = solved(pair, n, depth, bit)[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(level.ids >> 16), pa.array(level.ids >> 8 & 255), pa.array(level.ids & 255), pa.array(level.zeros), pa.array(level.ones),
                     pa.array(level.whole)], names=["near", "far", "node", "zeros", "ones", "whole"])

    def merged(near: pa.Table) -> pa.Table:
        near = near.sort_by([("node", "ascending"), ("far", "ascending")])
        node = near["node"].to_numpy()
        opens = np.flatnonzero(np.diff(node, prepend=-1))
        sums = {name: np.add.reduceat(near[name].to_numpy(), opens) for name in ("zeros", "ones", "whole")}
        return pa.table({"near": near["near"].to_numpy()[opens], "node": node[opens], **sums})

    # A group has 256 x 255 rows at most, the result 256 x 255 rows.
    nodes = rows.mapInArrow(roots, "near long, far long, node long, zeros double, ones double, whole double") \
        .groupBy("near").applyInArrow(merged, "near long, node long, zeros double, ones double, whole double").collect()
    top = Top()
    for r in nodes:
        for table, name in ((top.zeros, "zeros"), (top.ones, "ones"), (top.below, "whole")):
            table[r["near"], r["node"]] = r[name]
    sent = pairs.sparkSession.sparkContext.broadcast(top)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, n in subtrees(batches, depth):
            log_p = np.zeros(len(pair))
            for bit in range(8):
                value, node = pair >> (7 - bit) & 1, 1 << bit | (pair & 255) >> (8 - bit)
                p = None
                for level in solved(pair, n, depth, bit):
                    p = level.next_bit(value, p)
                log_p += np.log10(sent.value.mix(pair >> 8 * depth, node, value, p))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(log_p)], names=["pair", "log_p"])

    return rows.mapInArrow(logs, "pair long, log_p double")


# --- scores ----------------------------------------------------------------------

class Table:
    """One block's pairs with their log probabilities, and words with their counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[bytes, int] = {}
        self.pairs: np.ndarray | None = None

    def close(self) -> None:
        if self.pairs is None:
            pairs, logs = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            order = np.argsort(pairs)
            self.pairs, self.logs = pairs[order], logs[order]

    def model_scores(self, texts: list[bytes], depth: int) -> np.ndarray:
        self.close()
        pairs, starts = pairs_of(texts, depth)
        return np.add.reduceat(self.logs[np.searchsorted(self.pairs, pairs)], starts)


def score(
    docs: DataFrame, depth: int = DEPTH, rest: int = 2, modulo: int = 7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte (of the bytes and the end).

    Documents whose crc32(id as text) leaves ``rest`` modulo ``modulo`` are held
    out of all counts. The base score is that of single words with one added to
    each count; a word is known if it was counted.
    """
    if not TOP_BYTES <= depth <= 6:
        raise ValueError("depth must be 2 to 6 bytes")
    prepared_for_rows(docs.sparkSession)
    table = dealt(id_and_text(docs, id_col, text_col), depth, rest, modulo)
    by_block = {kind: table.filter(F.col(kind).isNotNull()).select("block", kind, "n") for kind in ("pair", "word")}
    pairs, words = (written(by_block[kind].groupBy(kind).agg(F.sum("n").alias("n"))) for kind in ("pair", "word"))
    known = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    ends = table.filter("blob is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = known["n"] + ends, known["kinds"] + (ends > 0)

    logs = by_block["pair"].select("block", "pair").join(probabilities(pairs, depth), "pair")
    counts = by_block["word"].select("block", "word").join(words, "word")
    texts = table.filter("blob is not null").select("block", "blob")
    rows = (
        logs.withColumn("kind", F.lit(0)).unionByName(counts.withColumn("kind", F.lit(1)), True).unionByName(texts.withColumn("kind", F.lit(2)), True)
        .select("block", "kind", "pair", "log_p", "word", "n", "blob")
        .repartition("block").sortWithinPartitions("block", "kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = Table(), None
        for batch in batches:
            keys = batch.column(0).to_numpy() * 4 + batch.column(1).to_numpy()
            opens = [*np.flatnonzero(np.diff(keys, prepend=-1)).tolist(), len(keys)]
            for a, b in pairwise(opens):
                part = batch.slice(a, b - a)
                if keys[a] >> 2 != block:
                    held, block = Table(), keys[a] >> 2
                if keys[a] & 3 == 0:
                    held.parts.append((part.column(2).to_numpy(), part.column(3).to_numpy()))
                elif keys[a] & 3 == 1:
                    held.words.update(zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True))
                else:
                    for blob in part.column(6).to_pylist():
                        yield scored(held, *unpacked(blob))

    def scored(held: Table, ids: list, learned: list[bool], raw: list[bytes]) -> pa.RecordBatch:
        of_model = held.model_scores(raw, depth)
        n_tokens, n_known, base = [], [], []
        for text in raw:
            tokens = text.split()
            times = np.fromiter(map(held.words.__getitem__, tokens), np.int64, len(tokens))
            n_tokens.append(len(tokens) + 1)
            n_known.append(int(np.count_nonzero(times)) + (ends > 0))
            base.append(float(np.log10(times + 1.0).sum() + np.log10(ends + 1.0) - (len(tokens) + 1) * np.log10(total + kinds + 1.0)))
        sizes = np.array([len(t) + 1 for t in raw])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([not x for x in learned]), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
             pa.array(np.full(len(raw), total)), pa.array(base), pa.array(of_model), pa.array(-of_model / np.log10(2) / sizes)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return rows.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
