"""Fill-in-middle: cuts a text at two token bounds and writes its parts in another order.

The token bounds of a text (code points, 0 included) are held in a boundary set
of the Roaring kind: values share a container by their upper 16 bits, and a
container is whichever is smallest of a sorted array, a bitmap and a list of
runs. Cumulative cardinalities find the container of the k-th bound, a local
select finds the bound itself; so either cut is two searches, however long the
text is. Which cuts and which order are taken depends on the seed and the
document's id alone, so a lost task repeats its rows exactly.

Every text is transformed where it is read; nothing is shuffled. ``restore``
undoes the transformation with column expressions.

Defined cases: null text is empty; empty texts and texts that hold a marker
stay plain. A null id is hashed as an empty one. Rows that repeat are
transformed each on its own, and alike. Texts of any length are cut whole; an
empty table gives an empty table. Further columns of ``docs`` are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import id_and_text, prepared

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
MARKERS = ("<P>", "<S>", "<M>")
SPACE = 1 << 16
BITMAP_BYTES = SPACE // 8
CELL = 64


class ArrayContainer:
    """Sorted 16-bit values as they are."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each of the 65,536 values, in cells with running counts."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPACE, np.uint8)
        bits[low] = 1
        self.cells = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.cells), dtype=np.int64)

    def select(self, k: int) -> int:
        cell = int(np.searchsorted(self.before, k, side="right"))
        rest = k - (int(self.before[cell - 1]) if cell else 0)
        inside = np.flatnonzero(np.unpackbits(self.cells[cell:cell + 1].view(np.uint8), bitorder="little"))
        return cell * CELL + int(inside[rest])


class RunContainer:
    """First value and running length of every run of consecutive values."""

    def __init__(self, first: np.ndarray, lengths: np.ndarray):
        self.first, self.until = first, np.cumsum(lengths)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.until, k, side="right"))
        return int(self.first[run]) + k - (int(self.until[run - 1]) if run else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three for these sorted distinct values below 65,536."""
    opens = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(opens) < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low[opens], np.diff(opens, append=len(low)))
    return ArrayContainer(low) if 2 * len(low) <= BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """Sorted distinct offsets; ``select(k)`` is the k-th, from 0."""

    def __init__(self, offsets: np.ndarray):
        high = offsets // SPACE
        opens = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[opens]
        self.until = np.append(opens[1:], len(offsets))
        self.containers = [
            container(offsets[a:b] - h * SPACE) for a, b, h in zip(opens, self.until, self.high, strict=True)]

    def __len__(self) -> int:
        return int(self.until[-1]) if len(self.until) else 0

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.until, k, side="right"))
        before = int(self.until[at - 1]) if at else 0
        return int(self.high[at]) * SPACE + self.containers[at].select(k - before)


def bounds(text: str) -> BoundarySet:
    """0 and the ends of the tokens `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    # A token ends where a word does; white space that ends the text is a token of its own.
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return BoundarySet(np.concatenate([[0], ends, [len(points)]]) if len(points) else np.zeros(1, np.int64))


def draws(doc_id: int | None, seed: int) -> Sequence[int]:
    """Four 32-bit numbers from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def cut(doc_id: int | None, text: str, seed: int, fim_percent: int, spm_percent: int, markers: Sequence[str]) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    held = bounds(text)
    n = len(held) - 1
    one, two, whether, which = draws(doc_id, seed)
    if not text or whether % 100 >= fim_percent or any(m in text for m in markers):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = held.select(low), held.select(high)
    for_prefix, for_suffix, for_middle = markers
    prefix, suffix = for_prefix + text[:a], for_suffix + text[b:]
    form = "spm" if which % 100 < spm_percent else "psm"
    ahead = suffix + prefix if form == "spm" else prefix + suffix
    return n, form, a, b - a, ahead + for_middle + text[a:b]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
    markers: Sequence[str] = MARKERS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``fim_percent`` of the documents are cut, ``spm_percent`` of those in the
    order suffix, prefix, middle. Markers must begin with a character they hold
    once, which keeps them from running into the text around them.
    """
    if len(set(markers)) != 3 or any(not m or m[0] in m[1:] or m[0] != markers[0][0] for m in markers):
        raise ValueError("three different markers with the same first character, found nowhere else in them")
    prepared(docs.sparkSession)
    markers = tuple(markers)
    columns = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.large_string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(i, t, seed, fim_percent, spm_percent, markers)
                    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            made = zip(*rows, strict=True) if rows else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(made, columns.values(), strict=True)]], names=["doc_id", *columns])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that ``output`` was made from."""
    for_prefix, for_suffix, for_middle = markers
    ahead = F.substring_index(output, for_middle, 1)
    middle = F.substring_index(output, for_middle, -1)
    prefix = F.substring_index(F.substring_index(ahead, for_prefix, -1), for_suffix, 1)
    suffix = F.substring_index(F.substring_index(ahead, for_suffix, -1), for_prefix, 1)
    return F.when(form == "plain", output).otherwise(reduce(F.concat, [prefix, middle, suffix]))


def restore(made: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """doc_id, text of rows of ``fill_in_middle``."""
    return made.select("doc_id", restored(made["form"], made["output"], markers).alias("text"))


def digests(made: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with digests in place of the output."""

    def sha256(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(made["output"]).alias("output_sha256"),
        sha256(restored(made["form"], made["output"])).alias("restored_sha256"))


def oracle() -> str:
    """The registered query in SQL, with a regular expression in place of the boundary set."""
    return f"""
        with d as (
            select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h,
                regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as tokens
            from documents
        ), k as (
            select *, len(tokens) as n, ('0x' || h[1:8])::bigint % (len(tokens) + 1) as h1, ('0x' || h[9:16])::bigint % (len(tokens) + 1) as h2,
                ('0x' || h[17:24])::bigint % 100 as h3, ('0x' || h[25:32])::bigint % 100 as h4
            from d
        ), f as (
            select *, array_to_string(tokens[1:least(h1, h2)], '') as a,
                array_to_string(tokens[least(h1, h2) + 1:greatest(h1, h2)], '') as b, array_to_string(tokens[greatest(h1, h2) + 1:], '') as c,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= {FIM_PERCENT}
                    then 'plain' when h4 < {SPM_PERCENT} then 'spm' else 'psm' end as form
            from k
        )
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end::bigint as prefix_chars,
            case when form <> 'plain' then length(b) end::bigint as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b
                else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256,
            sha256(text) as restored_sha256
        from f
    """
