"""Phrase collocations: counted by Rabin-Karp fingerprints, length by length.

A prefix polynomial over the bytes of a window of text gives the fingerprint of
every n-gram as the difference of two prefixes, shifted to the origin. Each scan
counts fingerprints of one length (the longer ones two at a time) and adds them
up by a shuffle. An n-gram is only counted if all its parts of the length before
were frequent, which a bit screen of bounded size tells; a screen may let an
infrequent one pass, never hold a frequent one back.

Fingerprints decide only what is looked at again. The last scan follows the
occurrences whose fingerprint passed into the text and counts the phrases
themselves, so two phrases of one fingerprint are told apart, and strings exist
for frequent phrases alone.

A screen has ``BITS_PER_KEY`` bits for each frequent fingerprint, ``MOST_BITS``
at most; beyond, it lets more pass, which costs shuffled rows and changes no
result. Windows have bounded bytes, whatever the length of a text.

Defined cases: null text is empty; null language is `und`. A null id is never
looked at, as ids play no part. Repeated rows count each. Ties are ordered by
count, then phrase. An empty table, or one without frequent phrases, gives an
empty table. Further columns of ``docs`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayrunner.llm.common import prepared_for_rows
from dayrunner.session import written

MOST_WORDS = 5
LEAST_COUNT = 100
COVER_PERCENT = 100
TOP = 2_000
UNKNOWN_LANGUAGE = "und"

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
WINDOW_BYTES = 1 << 20
GATHERED_BYTES = 1 << 23
HELD_PHRASES = 1 << 18
BITS_PER_KEY = 16
MOST_BITS = 1 << 28
SLICES = 64

# Ends of pieces become line breaks, tabs spaces.
ENDS = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9)
BREAK = re.compile(rb"[ \n]")


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 … BASE^(n-1) and their inverses, modulo 2^64."""
    made = []
    for base in (BASE, INVERSE):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        made.append(np.multiply.accumulate(row))
    return made[0], made[1]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads polynomial values over all 64 bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


@dataclass(frozen=True)
class Screen:
    """Bits of known fingerprints, in slices chosen by their upper bits; two bits a key."""

    bits: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(slice_bits - 1)
        return keys & last, ((keys * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(24)) & last

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slice_bits = len(self.bits) * 8 // SLICES
        start = (keys >> np.uint64(64 - (SLICES - 1).bit_length())) * np.uint64(slice_bits)
        found = np.ones(len(keys), bool)
        for place in self.places(keys, slice_bits):
            at = start + place
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def plain(texts: list[str]) -> bytes:
    """Lower-cased texts as lines of words with one space between them."""
    raw = "\n".join(texts).encode().lower().translate(ENDS)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def windows(raw: bytes, most_words: int) -> Iterator[tuple[bytes, int]]:
    """Stretches of the text with the words that may follow a phrase's first one,
    and the number of bytes in which phrases of this stretch start."""
    ahead = re.compile(rb"(?: [^ \n]+){0,%d}" % (most_words - 1))
    at = 0
    while at < len(raw):
        found = BREAK.search(raw, at + WINDOW_BYTES)
        if found is None:
            yield raw[at:], len(raw) - at
            return
        yield raw[at:ahead.match(raw, found.start()).end()], found.start() - at
        at = found.start()


class Words:
    """Words of one window and the fingerprints of its n-grams."""

    def __init__(self, raw: bytes, own: int, seed: int):
        data = np.frombuffer(raw, np.uint8)
        gap = (data == 32) | (data == 10)
        outside = np.concatenate([[True], gap, [True]])
        self.starts = np.flatnonzero(outside[:-2] & ~gap)
        self.ends = np.flatnonzero(~gap & outside[2:]) + 1
        self.own = int(np.searchsorted(self.starts, own))
        joined = (self.starts[1:] - self.ends[:-1] == 1) & (data[self.ends[:-1]] == 32) if len(self.starts) else np.zeros(0, bool)
        # Words from here on that stand in one piece, this one included.
        last = np.append(np.flatnonzero(~joined), len(self.starts) - 1) if len(self.starts) else np.zeros(0, int)
        self.room = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(self.starts)) + 1
        power, self.back = powers(max(WINDOW_BYTES * 2, 1 << len(raw).bit_length()))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], dtype=np.uint64)])
        self.seed = np.uint64(seed)

    def prints(self, first: np.ndarray, words: int) -> np.ndarray:
        start, end = self.starts[first], self.ends[first + words - 1]
        return mixed((self.prefix[end] - self.prefix[start]) * self.back[start] ^ self.seed)

    def known(self, words: int, screen: Screen) -> np.ndarray:
        """For each word: whether the phrase that starts there is one of the screen's."""
        first = np.flatnonzero(self.room >= words)
        out = np.zeros(len(self.starts), bool)
        out[first] = screen.holds(self.prints(first, words))
        return out

    def candidates(self, words: int, part: int, known: np.ndarray | None) -> np.ndarray:
        """First words of this window's phrases all of whose parts of ``part`` words are known."""
        first = np.flatnonzero(self.room[:self.own] >= words)
        for shift in range(words - part + 1 if known is not None else 0):
            first = first[known[first + shift]]
        return first


def language_seed(language: str) -> int:
    return int.from_bytes(hashlib.sha256(language.encode()).digest()[:8], "little")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[str]]]:
    """Texts by language, about GATHERED_BYTES at a time."""
    held: dict[str, list[str]] = defaultdict(list)
    size = 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[language].append(text)
            size += len(text)
            if size >= GATHERED_BYTES:
                yield held
                held, size = defaultdict(list), 0
    yield held


def words_of(texts: list[str], language: str, most_words: int) -> Iterator[tuple[bytes, Words]]:
    seed = language_seed(language)
    for raw, own in windows(plain(texts), most_words):
        yield raw, Words(raw, own, seed)


def frequent(rows: DataFrame, lengths: Sequence[int], part: int, screen, least: int) -> DataFrame:
    """Fingerprints of phrases of these lengths that occur ``least`` times; ``screen``
    is a broadcast of those of ``part`` words (None: all are candidates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_prints = Screen(screen.value) if screen else None
        for held in gathered(batches):
            found = [np.zeros(0, np.uint64)]
            for language, texts in held.items():
                for _, words in words_of(texts, language, max(lengths)):
                    known = words.known(part, known_prints) if known_prints else None
                    found += [words.prints(words.candidates(n, part, known), n) for n in lengths]
            prints, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts)], names=["print", "n"])

    return rows.mapInArrow(run, "print long, n long").groupBy("print").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("print")


def screen_of(spark: SparkSession, prints: DataFrame) -> np.ndarray:
    """Bit screen of a written table of fingerprints, filled slice by slice where the rows are."""
    wanted = max(1, prints.count()) * BITS_PER_KEY
    slice_bits = max(64, min(MOST_BITS, 1 << (wanted - 1).bit_length()) // SLICES)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            for k in np.unique(number := batch.column(0).to_numpy()):
                bits = slices.setdefault(int(k), np.zeros(slice_bits // 8, np.uint8))
                for place in Screen.places(keys[number == k], slice_bits):
                    np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(slices), pa.int32()), pa.array([b.tobytes() for b in slices.values()], pa.binary())], names=["slice", "bits"])

    shift = 64 - (SLICES - 1).bit_length()
    made = prints.select(F.shiftrightunsigned("print", shift).cast("int").alias("slice"), "print").repartition(SLICES, "slice")
    bits = np.zeros(slice_bits * SLICES // 8, np.uint8)
    for row in made.mapInArrow(fill, "slice int, bits binary").collect():  # SLICES rows at most, MOST_BITS in all
        bits[row["slice"] * slice_bits // 8:(row["slice"] + 1) * slice_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def counted_phrases(rows: DataFrame, screens: dict[int, object], most_words: int) -> DataFrame:
    """lang, phrase, words, a: exact counts of all phrases that pass the screens;
    a row with an empty phrase has the number of words of the language."""

    def table_of(held: dict[str, Counter]) -> pa.RecordBatch:
        flat = [(language, phrase, n) for language, counts in held.items() for phrase, n in counts.items()]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.binary()).cast(pa.string()),
            pa.array([r[1].count(b" ") + 1 if r[1] else 0 for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.int64()),
        ], names=["lang", "phrase", "words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {n: Screen(s.value) for n, s in screens.items()}
        held: dict[str, Counter] = defaultdict(Counter)
        for texts_by_language in gathered(batches):
            for language, texts in texts_by_language.items():
                counts = held[language]
                for raw, words in words_of(texts, language, most_words):
                    counts[b""] += words.own
                    for n, screen in opened.items():
                        first = words.candidates(n, n, words.known(n, screen))
                        starts, ends = words.starts[first].tolist(), words.ends[first + n - 1].tolist()
                        counts.update(map(raw.__getitem__, map(slice, starts, ends)))
            if sum(map(len, held.values())) >= HELD_PHRASES:
                yield table_of(held)
                held = defaultdict(Counter)
        yield table_of(held)

    return rows.mapInArrow(run, "lang string, phrase string, words int, a long").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def mine(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the
    lowest score, ``n`` all words; the score is floor(1000 a n / (l r)). A phrase
    goes if a longer one of those counted holds it ``cover_percent`` % of the time.
    """
    spark = prepared_for_rows(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    scans = [(n,) for n in range(1, min(3, most_words) + 1)] + [tuple(range(n, min(n + 2, most_words + 1))) for n in range(4, most_words + 1, 2)]
    screens: dict[int, object] = {}
    part = 0
    for lengths in scans:
        prints = written(frequent(rows, lengths, part, screens.get(part), least))
        opened = spark.sparkContext.broadcast(screen_of(spark, prints))
        screens |= dict.fromkeys(lengths, opened)
        part = lengths[-1]
    counts = written(counted_phrases(rows, screens, most_words).filter((F.col("words") == 0) | (F.col("a") >= least)))
    return ranked(counts.filter("words > 0"), counts.filter("words = 0").select("lang", F.col("a").alias("n")), cover_percent, top)


def ranked(phrases: DataFrame, totals: DataFrame, cover_percent: int, top: int) -> DataFrame:
    """The phrases of two words and more by the score of their weakest cut."""
    longer = phrases.filter("words > 1")
    ones = phrases.select("lang", "phrase", "a")
    cuts = (
        longer.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
        .withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
        .join(ones.selectExpr("lang", "phrase as left", "a as l"), ["lang", "left"])
        .join(ones.selectExpr("lang", "phrase as right", "a as r"), ["lang", "right"])
        .join(totals, "lang")
        # Exact: the products may pass 64 bits.
        .withColumn("score", F.expr(
            "(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)))"
            " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    )
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A part of a frequent phrase is frequent, so phrases one word longer are enough.
    covers = (
        phrases.filter("words > 2")
        .select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    )
    kept = scored.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("held") < F.lit(cover_percent) * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    )


def oracle() -> str:
    """The registered query in SQL."""
    return f"""
        with pieces as (
            select coalesce(lang, '{UNKNOWN_LANGUAGE}') as lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents
        ), w as (
            select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from pieces
        ), totals as (
            select lang, sum(len(ws))::bigint as n from w group by 1
        ), grams as (
            select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
            from w, range(1, {MOST_WORDS + 1}) as s(k) where len(ws) >= k
        ), f as (
            select lang, phrase, k, count(*) as a from grams group by all having count(*) >= {LEAST_COUNT}
        ), cuts as (
            select f.*, unnest(range(1, k)) as cut, string_split(phrase, ' ') as ws from f where k > 1
        ), scored as (
            select c.lang, c.phrase, c.k, c.a, x.a as l, y.a as r, n, (1000::hugeint * c.a * n // (x.a::hugeint * y.a))::bigint as score,
                row_number() over (partition by c.lang, c.phrase order by 1000::hugeint * c.a * n // (x.a::hugeint * y.a), cut) as pick
            from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1:cut], ' ')
                join f y on y.lang = c.lang and y.phrase = array_to_string(ws[cut + 1:], ' ') join totals t on t.lang = c.lang
        ), chosen as (
            select * from scored s where pick = 1 and not exists (
                select 1 from f where f.lang = s.lang and f.k > s.k and contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ')
                    and 100 * f.a >= {COVER_PERCENT} * s.a)
        ), ranks as (
            select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from chosen
        )
        select lang, rank, phrase, a, l, r, n, score from ranks where rank <= {TOP}
    """
