"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans are the leftmost, non-overlapping matches of four fixed patterns, each
followed by a check. Positions come from splitting a text at its matches: the
lengths of the pieces add up to the starts.

The bootstrap works on identifier-like words (with a digit or an @) and the word
and signs in front of each. Values that a base pattern or a further seed pattern
recognises are seeds of a kind. In a few rounds over the graph of contexts and
values, contexts are scored by the share of their distinct values that are known
to be of the kind, and values by the contexts that extract them; well-scored
values join the known ones. Occurrences of values found that way, other than the
seeds, become spans of that kind.

Everything is DataFrame expressions; only contexts and values are shuffled, once
each after combining, and no text is.

Defined cases: a null text is empty. Rows that repeat are scored each on its own,
and count once as evidence. A null id stays. Equal scores for two kinds: the kind
that sorts first. A text's spans are sorted by kind, then start, then end. Very
long texts are searched whole; time grows with their length, and with the
logarithm of the number of identifiers in one text. Empty tables give no rows;
columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.llm.common import id_and_text, prepared
from dayrunner.session import written

KINDS = ("email", "ip", "card", "phone")
# A match may start where the one before ended, or at the start of a run; that is
# the leftmost match without trying every place of a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
# Any number of zeros, then nothing or a number without leading zeros.
PART_255 = r"(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?+"
IP_VALID = rf"^{PART_255}(?:\.{PART_255}){{3}}$"

# Identifier-like words, and what a context is made of.
CANDIDATE = PATTERNS["phone"] + r"|(?:\G|(?<![A-Za-z0-9._%@-]))(?=[A-Za-z._%-]*+[0-9@])[A-Za-z0-9._%@-]{6,}+"
CONTEXT_CHARS = 48
CONTEXT_WORD = r"([A-Za-z]+)[^A-Za-z0-9]*$"
CONTEXT_SIGNS = r"([^A-Za-z0-9]*)$"
SEEDS = {"key": r"^[0-9a-f]{32,64}$"}
# Enough for 2 ** 30 places; a text of 2 ** 31 bytes holds fewer identifiers of six signs.
SUM_WIDTH = 32
SUM_ROUNDS = 6
ROUNDS = 3
LEAST_SUPPORT = 5
LEAST_PRECISION = 0.8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(place: Column) -> Column:
        digit = F.substring(digits, place, 1).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when((n - place) % 2 == 1, doubled).otherwise(digit)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_VALID)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["value"])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _running_sum(lengths: Column) -> Column:
    """Sums of an array's numbers up to each place. Every round adds the ``SUM_WIDTH`` sums
    that end a reach apart, and the reach grows by that factor: the work grows with the
    array's length times the logarithm of that."""

    def round_of(reach: int) -> Callable[[Column], Column]:
        def added(a: Column, i: Column) -> Column:
            back = F.sequence(F.lit(0), F.least(F.lit(SUM_WIDTH - 1), F.floor(i / reach).cast("int")))
            return F.aggregate(back, F.lit(0), lambda total, k: total + F.get(a, i - k * reach))

        return lambda a: F.when(F.size(a) > reach, F.transform(a, lambda _, i: added(a, i))).otherwise(a)

    for n in range(SUM_ROUNDS):
        lengths = _once(lengths, round_of(SUM_WIDTH ** n))
    return lengths


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of a pattern's matches, in code points."""
    empty = F.lit([]).cast("array<struct<start:int,end:int,value:string,before:string>>")

    def paired(values: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        return F.zip_with(values, between, lambda v, b: F.struct(
            v.alias("value"), F.right(b, F.lit(CONTEXT_CHARS)).alias("before"), F.length(v).alias("long"),
            (F.length(b) + F.length(v)).alias("step")))

    def placed(pairs: Column) -> Column:
        ends = _running_sum(F.transform(pairs, lambda p: p["step"]))
        return F.zip_with(pairs, ends, lambda p, e: F.struct(
            (e - p["long"]).alias("start"), e.alias("end"), p["value"].alias("value"), p["before"].alias("before")))

    def found(values: Column) -> Column:
        return F.when(F.size(values) == 0, empty).otherwise(_once(paired(values), placed))

    return _once(F.regexp_extract_all(text, F.lit(pattern), 0), found)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and per base kind an array of (start, end, value)."""
    rows = id_and_text(docs, id_col, text_col)
    for kind in KINDS:
        found = _located(F.col("text"), PATTERNS[kind])
        if kind in NEEDED:
            nothing = F.lit([]).cast("array<struct<start:int,end:int,value:string,before:string>>")
            found = F.when(F.contains("text", F.lit(NEEDED[kind])), found).otherwise(nothing)
        rows = rows.withColumn(kind, F.filter(found, _check(kind)))
    return rows


def _seed_kind(value: Column, seeds: dict[str, str]) -> Column:
    """The kind a value is known to be of, or null."""
    kind = F.when(value.rlike(f"^(?:{PATTERNS['email'].partition('))')[2]})$"), "email")
    kind = kind.when(value.rlike(IP_VALID), "ip")
    kind = kind.when(value.rlike("^[0-9-]+$") & valid("card", value), "card")
    kind = kind.when(value.startswith("+") & valid("phone", value), "phone")
    for name, pattern in sorted(seeds.items()):
        kind = kind.when(value.rlike(pattern), name)
    return kind


def _seen(text: Column, seeds: dict[str, str]) -> Column:
    """Array of the identifier-like words: start, end, value, context, seed."""

    def described(word: Column) -> Column:
        value = F.rtrim(word["value"], F.lit(".-"))
        ahead = F.lower(F.regexp_extract(word["before"], CONTEXT_WORD, 1))
        signs = F.regexp_replace(F.regexp_extract(word["before"], CONTEXT_SIGNS, 1), r"\s+", " ")
        return F.struct(
            word["start"].alias("start"), (word["start"] + F.length(value)).alias("end"), value.alias("value"),
            F.concat(ahead, F.lit("|"), signs).alias("context"), _seed_kind(value, seeds).alias("seed"))

    return F.transform(_located(text, CANDIDATE), described)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT, precision: float = LEAST_PRECISION) -> DataFrame:
    """value, kind, score of the values found beside the seeds.

    ``edges`` has context, value and seed (null where not known). A context
    counts for a kind with at least ``support`` known values that make up at
    least ``precision`` of its values.
    """
    graph = written(edges.groupBy("context", "value").agg(F.first("seed").alias("seed")))
    sizes = graph.groupBy("context").agg(F.count("*").alias("values"))
    known = graph.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(True).alias("seeded")).distinct()
    for _ in range(rounds):
        known = written(known)
        trusted = (
            graph.join(known, "value").groupBy("context", "kind").agg(F.count("*").alias("held"), F.sum("score").alias("weight"))
            .filter(F.col("held") >= support).join(sizes, "context")
            .withColumn("precision", F.col("weight") / F.col("values")).filter(F.col("precision") >= precision)
        )
        ranked = (
            graph.filter("seed is null").join(trusted.select("context", "kind", "precision"), "context")
            .groupBy("value", "kind").agg((1 - F.product(1 - F.col("precision") * F.lit(0.999))).alias("score"))
            .groupBy("value").agg(F.max("score").alias("score"), F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
        )
        known = known.filter("seeded").unionByName(
            ranked.select("value", "kind", "score", F.lit(False).alias("seeded")))
    return written(known.filter("not seeded")).select("value", "kind", "score")


def _names(spans: Column, kind: Column | str) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.concat_ws(":", name, s["start"].cast("string"), s["end"].cast("string")))


def _placed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def find(docs: DataFrame, seeds: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id; email, ip, card, phone: arrays of (start, end, value);
    added: array of (kind, start, end, value) of seeds of further kinds and of values found."""
    prepared(docs.sparkSession)
    seeds = SEEDS if seeds is None else seeds
    marked = written(
        base_spans(docs, id_col, text_col).select(
            "doc_id", F.xxhash64("text").alias("text_key"), *[_placed(F.col(k)).alias(k) for k in KINDS],
            _seen(F.col("text"), seeds).alias("seen"))
    )
    words = marked.select("doc_id", "text_key", F.explode("seen").alias("w")).select("doc_id", "text_key", "w.*")
    found = bootstrap(words.select("context", "value", "seed"))
    span = F.struct("kind", "start", "end", "value")
    known = words.filter(F.col("seed").isin(*sorted(seeds))).withColumn("kind", F.col("seed"))
    new = words.filter("seed is null").join(found.select("value", "kind"), "value")
    added = (
        known.select("doc_id", "text_key", span.alias("span")).unionByName(new.select("doc_id", "text_key", span.alias("span")))
        .groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.sort_array(F.collect_set("span")).alias("added"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    nothing = F.lit([]).cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return marked.join(added, same, "left").select("doc_id", *KINDS, F.coalesce("added", nothing).alias("added"))


def _merged() -> Column:
    """Names of the base spans and the added ones: base kinds as listed, then others, each by start."""
    def of_kind(kind: str) -> Column:
        more = F.transform(F.filter("added", _is_kind(kind)), lambda s: F.struct(s["start"], s["end"], s["value"]))
        return _names(F.array_sort(F.concat(F.col(kind), more)), kind)

    others = F.filter("added", lambda s: ~s["kind"].isin(*KINDS))
    return F.concat(*[of_kind(k) for k in KINDS],
                    F.transform(others, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and n_added."""
    base = F.concat(*[_names(F.col(k), k) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(_merged(), ",").alias("spans"), F.size("added").cast("long").alias("n_added"))
