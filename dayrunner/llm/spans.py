"""Substring dedup: runs of consecutive sentences that occur before are removed.

A text is cut into sentences at sentence ends and line breaks; a long sentence is
cut on after the word with the least hash of every few consecutive ones, so that a
passage is cut alike wherever it stands, and no stretch stays without a cut. In
scripts without spaces, each sign is a word for that, of less length. From every sentence a run goes on until it has at least two
sentences and LEAST_WORDS words. Runs are hashed with 128 bits and counted over
all documents. The first occurrence of a run is that in the document with the
smallest id, and the first there; sentences covered by any other occurrence are
removed.

A run that a document repeats travels once. The runs of a passage that a third
of all documents share meet only in a count
and a minimum that combine before the shuffle, and in a join that skew splitting
may divide.

Defined cases: null and empty texts have no sentences and stay empty. White space
between words doesn't count. Documents that repeat an id don't remove from one
another. A null id takes no part; its text stays. Runs cut short by the end of
the text are not compared. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import id_and_text, prepared
from dayrunner.session import written

LEAST_SENTENCES = 2
LEAST_WORDS = 20
LONG_SENTENCE = 12
# Every stretch of so many words of a long sentence holds a cut. A passage of
# LEAST_WORDS + 4 * CUT_WINDOW - 3 words, here 49, is certain to hold a run.
CUT_WINDOW = 8
# Signs of scripts written without spaces are words of their own, and count as a
# half (ideographs, kana and full-width signs) or a quarter (Thai, Lao, Myanmar,
# Khmer and their like) of a word.
HALVES = "\u3001-\u303f\u3040-\u30ff\u3105-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U0001b000-\U0001b16f\U00020000-\U000323af"
QUARTERS = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\ua9e0-\ua9ff\uaa60-\uaadf"
UNSPACED = re.compile(f"[{HALVES}{QUARTERS}]")
QUARTER = re.compile(f"[{QUARTERS}]")
# The least of these signs and all above them: quicker to look for.
HIGH = re.compile("[\u0e00-\U0010ffff]")
# A sentence ends with closing signs before white space, with a full stop of
# another script whatever follows, or at a line break.
STOPS = "\u3002\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u1362\u1367\u1368\u104a\u104b\u17d4\u17d5\u0f0d\u0f0e"
END = re.compile(rf"[.!?\n{STOPS}](?:(?<=\n)|(?<=[{STOPS}])[{STOPS}]*|(?<=[.!?])[.!?]*(?=\s))")
WORD = re.compile(r"\S+")
SIGN_OR_WORD = re.compile(rf"[{HALVES}{QUARTERS}]|[^\s{HALVES}{QUARTERS}]+")


class _Ranks(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        rank = self[word] = xxhash.xxh32_intdigest(word)
        return rank


_ranks = _Ranks()


def cuts(texts: list[list[str]]) -> list[list[int]]:
    """For each list of words, the places after which it is cut: the word with the
    least hash of every CUT_WINDOW consecutive words, the last of equal ones."""
    sizes = [len(words) for words in texts]
    total = sum(sizes)
    if total < CUT_WINDOW:
        return [[] for _ in texts]
    ranks = np.fromiter(map(_ranks.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=total)
    least = (ranks << np.uint64(32)) | np.arange(2**32 - 1, 2**32 - 1 - total, -1, dtype=np.uint64)
    width = 1
    while width < CUT_WINDOW:
        step = min(width, CUT_WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = of[:len(least)] == of[CUT_WINDOW - 1:]
    places = np.unique(np.uint64(2**32 - 1) - (least[inside] & np.uint64(2**32 - 1))).astype(np.int64)
    starts = np.cumsum([0, *sizes])
    edges = np.searchsorted(places, starts).tolist()
    local = (places - starts[of[places]]).tolist()
    return [local[a:b] for a, b in pairwise(edges)]


def unspaced(text: str) -> bool:
    """Whether there is a sign of a script written without spaces."""
    return not text.isascii() and HIGH.search(text) is not None and UNSPACED.search(text) is not None


def sentences(text: str, placed: bool = True) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of every sentence or part of a long one; parts have no places unless ``placed``."""
    word = SIGN_OR_WORD if unspaced(text) else WORD
    found = []
    ends = [m.end() for m in END.finditer(text)]
    for at, end in zip([0, *ends], [*ends, len(text)], strict=True):
        piece = text[at:end]
        words = piece.split() if word is WORD else word.findall(piece)
        if words:
            found.append((at + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip()), words))
    long = iter(cuts([words for *_, words in found if len(words) > LONG_SENTENCE]))
    out = []
    for at, end, words in found:
        places = next(long) if len(words) > LONG_SENTENCE else ()
        if not places:
            out.append((at, end, words))
            continue
        spots = [m.span() for m in word.finditer(text, at, end)] if placed else [(0, 0)] * len(words)
        first = 0
        for place in places:
            out.append((spots[first][0], spots[place][1], words[first:place + 1]))
            first = place + 1
        if first < len(words):
            out.append((spots[first][0], end, words[first:]))
    return out


def quarters(words: list[str], joined: str) -> int:
    """The length of a sentence in quarters of a word."""
    if not unspaced(joined):
        return 4 * len(words)
    return sum(4 if not UNSPACED.match(w) else 1 if QUARTER.match(w) else 2 for w in words)


def runs(found: list[tuple[int, int, list[str]]], least_words: int) -> list[tuple[int, int, int, int]]:
    """(first sentence, number of sentences, two halves of the hash) of every run."""
    joined = [" ".join(words) for _, _, words in found]
    sizes = [quarters(words, text) for (_, _, words), text in zip(found, joined, strict=True)]
    least, out, end, held = 4 * least_words, [], 0, 0
    for at in range(len(found)):
        while end < len(found) and (end - at < LEAST_SENTENCES or held < least):
            held += sizes[end]
            end += 1
        if end - at < LEAST_SENTENCES or held < least:
            break
        h = xxhash.xxh3_128_intdigest("\n".join(joined[at:end]))
        out.append((at, end - at, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
        held -= sizes[at]
    return out


RUN = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("times", pa.int32())])


def all_runs(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """The runs of every document, each once: doc_id, h1, h2, times."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, second, times = columns = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = Counter((h1, h2) for _, _, h1, h2 in runs(sentences(text, placed=False), least_words))
                ids += [doc_id] * len(held)
                first += [h1 for h1, _ in held]
                second += [h2 for _, h2 in held]
                times += held.values()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RUN.types, strict=True)], schema=RUN)

    return id_and_text(docs, id_col, text_col).filter("doc_id is not null") \
        .mapInArrow(cut, "doc_id long, h1 long, h2 long, times int")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs that occur more than once, by document: doc_id, h1, h2, first (the document has the first of all)."""
    found = written(all_runs(docs, least_words, id_col, text_col))
    # One half of the hash tells the runs that may repeat; most don't, and only
    # the others are looked at whole.
    often = found.groupBy("h1").agg(F.sum("times").alias("times")).filter("times > 1").select("h1")
    near = written(found.join(often.hint("merge"), "h1"))
    counted = near.groupBy("h1", "h2").agg(F.sum("times").alias("all_times"), F.min("doc_id").alias("first_id")).filter("all_times > 1")
    return near.join(counted.hint("merge"), ["h1", "h2"]).select(
        "doc_id", "h1", "h2", (F.col("doc_id") == F.col("first_id")).alias("first"))


def dedup_spans(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (what stays), n_repeated, n_removed, removed_words.

    ``n_repeated`` counts the sentences in any run that occurs elsewhere too,
    first occurrences included.
    """
    prepared(docs.sparkSession)
    marks = repeated_runs(docs, least_words, id_col, text_col).groupBy(F.col("doc_id").alias("of_id")) \
        .agg(F.collect_list(F.struct("h1", "h2", "first")).alias("marks"))
    rows = id_and_text(docs, id_col, text_col)
    # Marks grow with the corpus: neither side is broadcast.
    marked = rows.join(marks.hint("merge"), rows.doc_id == marks.of_id, "left").select("doc_id", "text", "marks")
    names = ["doc_id", "text", "n_repeated", "n_removed", "removed_words"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 3]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # Only the first occurrence in the first document stays.
                wanted = {(m["h1"], m["h2"]): m["first"] for m in marks or ()}
                found = sentences(text) if wanted else []
                repeated, removed = set(), set()
                for at, size, h1, h2 in runs(found, least_words):
                    first = wanted.get((h1, h2))
                    if first is not None:
                        repeated.update(range(at, at + size))
                        if first:
                            wanted[h1, h2] = False
                        else:
                            removed.update(range(at, at + size))
                kept, last = [], 0
                for k in sorted(removed):
                    start, end, _ = found[k]
                    kept.append(text[last:start])
                    last = end
                words = sum(quarters(found[k][2], " ".join(found[k][2])) for k in removed) // 4
                out.append((doc_id, "".join(kept) + text[last:], len(repeated), len(removed), words))
            columns = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return marked.mapInArrow(clean, "doc_id long, text string, n_repeated long, n_removed long, removed_words long")
