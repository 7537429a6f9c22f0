"""Byte-level BPE: merges by a segment tree of pair ranks, and decoding.

A piece of text (one match of the pre-tokenizer's pattern) starts as its bytes. A
segment tree over byte positions holds at each leaf the rank of the pair that
starts there, and at each inner node the least rank below it. A merge takes the
leftmost position of the least rank, joins that token with its live right
neighbour, and updates three leaves: its own, the one swallowed, and the live
left neighbour's. So a piece of n bytes costs n log n, however long it is. Pieces
of up to 64 bytes, nearly all there are, go through the same steps together, one
row of a numpy matrix each.

Encoding runs where the text is read; nothing is shuffled. A worker keeps
the encodings of recent pieces, up to a fixed number.

Defined cases: null text is empty and has no tokens. Lone surrogates can't occur
in a Spark string. Rows that repeat are encoded each on its own; a null id stays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dayrunner.llm.common import id_and_text, prepared

VOCABULARY = "byte_bpe_50k.tiktoken"
NEVER = 1 << 30
LEAVES = (4, 8, 16, 32, 64)
RECENT = 400_000
# A space that stands between two white-space characters (or ends a text after
# one) doesn't begin a piece. Such texts are matched by the pattern as a whole.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


class PairRanks:
    """Open-addressing table from a pair of token ids to the rank of its join."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.one = dict(zip(keys, values, strict=True))
        size = 1 << max(4, (8 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.last = size - 1
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NEVER, dtype=np.int32)
        key, value = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        at = self._home(key)
        while len(key):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[free]
            mine = self.keys[at] == key
            self.values[at[mine]] = value[mine]
            key, value, at = key[~mine], value[~mine], (at[~mine] + 1) & self.last

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where it doesn't merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NEVER).astype(np.int32)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.last
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Codec:
    """Encoder and decoder for one table of token ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(rank) for rank in range(len(self.tokens))]
        self.pieces = regex.compile(pattern)
        self.pairs = PairRanks(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.recent: dict[str, list[int]] = {}

    def _rank(self, left: int, right: int) -> int:
        return self.pairs.one.get(int(left) << 32 | int(right), NEVER)

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        size = 1 << (n - 1).bit_length()
        rank = self._rank
        tree = [NEVER] * (2 * size)
        tree[size:size + n - 1] = [rank(ids[i], ids[i + 1]) for i in range(n - 1)]
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) != NEVER:
            node = 1
            while node < size:
                node *= 2
                if tree[node] != least:
                    node += 1
            at = node - size
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone] = least, -1
            after[at] = right
            changed = [(gone, NEVER)]
            if right < n:
                before[right] = at
                changed.append((at, rank(least, ids[right])))
            else:
                changed.append((at, NEVER))
            if (left := before[at]) >= 0:
                changed.append((left, rank(ids[left], least)))
            for leaf, value in changed:
                node = leaf + size
                tree[node] = value
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    low = a if a <= b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
                    node >>= 1
        return [i for i in ids if i >= 0]

    def _merged_rows(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        """Token ids of pieces of at most ``leaves`` bytes, a segment tree a row."""
        rows = len(pieces)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, leaves)
        ids = self.byte_ids[raw]
        place = np.arange(leaves)
        ids[place >= length[:, None]] = -1
        # One column more takes the writes that fall beside the piece.
        after = np.tile(np.arange(1, leaves + 2), (rows, 1))
        before = np.tile(np.arange(-1, leaves), (rows, 1))
        tree = np.full((rows, 2 * leaves), NEVER, dtype=np.int32)
        has = place[1:] < length[:, None]
        tree[:, leaves:-1][has] = self.pairs.of(ids[:, :-1][has], ids[:, 1:][has])
        node = leaves
        while node > 1:
            tree[:, node // 2:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node //= 2
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            least = tree[live, 1]
            node = np.ones(len(live), dtype=np.int64)
            while node[0] < leaves:
                node *= 2
                node += tree[live, node] != least
            at = node - leaves
            gone = after[live, at]
            right, left = after[live, gone], before[live, at]
            ids[live, at] = least
            ids[live, gone] = -1
            after[live, at] = right
            ends = right >= length[live]
            before[live, np.where(ends, leaves, right)] = at
            with_right = np.full(len(live), NEVER, dtype=np.int32)
            inner = np.flatnonzero(~ends)
            with_right[inner] = self.pairs.of(least[inner], ids[live[inner], right[inner]])
            inner = np.flatnonzero(left >= 0)
            with_left = self.pairs.of(ids[live[inner], left[inner]], least[inner])
            tree[live, leaves + gone] = NEVER
            tree[live, leaves + at] = with_right
            tree[live[inner], leaves + left[inner]] = with_left
            row = np.concatenate([live, live, live[inner]])
            node = np.concatenate([gone, at, left[inner]]) + leaves
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NEVER]
        kept = ids >= 0
        flat = ids[kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merged_all(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct pieces."""
        done: dict[str, list[int]] = {}
        classes: dict[int, list[str]] = {n: [] for n in LEAVES}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                done[piece] = [whole]
            elif len(raw) > LEAVES[-1]:
                done[piece] = self.merged(raw)
            else:
                classes[max(LEAVES[0], 1 << (len(raw) - 1).bit_length())].append(piece)
        for leaves, members in classes.items():
            if members:
                done.update(zip(members, self._merged_rows([p.encode() for p in members], leaves), strict=True))
        return done

    def _pieces_of(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        return [chunk] if word.isalpha() else self.pieces.findall(chunk)

    def _chunks(self, text: str) -> list[str]:
        if INNER_SPACE.search(text):
            return self.pieces.findall(text)
        # every piece that has a space has it in front: cut there
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + c for c in rest]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        cut = [self._chunks(t) for t in texts]
        recent = self.recent
        missing = {c: self._pieces_of(c) for c in set(chain.from_iterable(cut)).difference(recent)}
        made = self._merged_all(set(chain.from_iterable(missing.values())))
        for chunk, parts in missing.items():
            recent[chunk] = made[parts[0]] if len(parts) == 1 else [i for p in parts for i in made[p]]
        out = [list(chain.from_iterable(map(recent.__getitem__, chunks))) for chunks in cut]
        for chunk in missing:
            if len(chunk) > LEAVES[-1]:
                del recent[chunk]
        if len(recent) > RECENT:
            recent.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def text_of(self, ids: list[int]) -> str:
        """The ids as decimal numbers with spaces between."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    return Codec(read_ranks(path), pattern)


def _per_text(docs: DataFrame, schema: str, columns: list[pa.DataType], row: Callable[[Codec, list[int]], tuple],
              path: str | None, pattern: str | None, id_col: str, text_col: str) -> DataFrame:
    prepared(docs.sparkSession)
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            rows = [row(coder, ids) for ids in coder.encode_all(batch.column(1).to_pylist())]
            made = zip(*rows, strict=True) if rows else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(made, columns, strict=True)]], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids."""

    def row(coder: Codec, ids: list[int]) -> tuple:
        return len(ids), ids

    return _per_text(docs, "doc_id long, n_tokens long, ids array<int>", [pa.int64(), pa.list_(pa.int32())],
                     row, path, pattern, id_col, text_col)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text; null ids are an empty list."""
    prepared(encoded.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            texts = [coder.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col]).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""

    def row(coder: Codec, ids: list[int]) -> tuple:
        written, decoded = coder.text_of(ids).encode(), coder.decode(ids)
        return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _per_text(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                     [pa.int64(), pa.string(), pa.string()], row, path, pattern, id_col, text_col)
