"""Fuzzy name matching of stops, routes and streets.

Score: the token sort ratio, twice the longest common subsequence over the sum
of lengths, of names in lower case, without parenthesised text, with their words
sorted.

Candidates: a pair of lengths m and n that reaches a score t has a common
subsequence of c >= t (m + n) / 2 signs; m - c signs of the one and n - c of the
other are left over. A sign left over parts at most two neighbouring pairs of
its own text and one of the other, so the two share m - 1 - 2 (m - c) - (n - c)
neighbouring pairs, which is (1.5 t - 1)(m + n) - 1 or more. As no common
subsequence is longer than the shorter text, n >= m t / (2 - t), and a text knows
the least number s it shares with any match. Put all its pairs in one fixed
order, rare ones first: if two texts share s, then their first (m - 1) - s + 2
have two in common. So texts meet in an equi-join on two neighbouring pairs. The
same holds for single signs with c in place of s; those are used for texts too
short for two neighbouring pairs (under 9 signs at 0.8, 39 at 0.7), which is
less selective. Every pair that reaches the score is found, and only pairs with
a common key are compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.operators import choose as G
from dayrunner.plans.views import FEED, ROUTE, STOP
from dayrunner.session import written

# Words that do not belong to a street's own name.
STREET_WORDS = "st|street|ave|avenue|rd|road|blvd|dr|drive|ln|lane|way"

# Stops with the same streets in one lot, and crossings that match them in another.
LOT = 1_000
# Pairs of a crossing and a stop that one task puts out.
TASK_PAIRS = 8_000_000
WORD = 32  # bits of a vector held in one long, which leaves room for the carry
# Signs that names have often, rarest first; all others count as rarer. Any order is right, this one is quick.
COMMON_LAST = "zqxjkvbywgpfmucdlhrsniotae9876543210 "


def normalized(name: Column | str) -> Column:
    """Lower case, no parenthesised text, words sorted and joined by one space."""
    c = F.col(name) if isinstance(name, str) else name
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    words = F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _signs(text: str) -> Column:
    return F.split(text, "")


def sign_masks(text: str) -> Column:
    """For every sign of a text the places it stands at, as bits, WORD of them a number."""
    signs, size = _signs(text), F.length(text)

    def word(sign: Column, w: Column) -> Column:
        places = F.sequence(F.lit(0), F.least(F.lit(WORD), size - w * WORD) - 1)
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda bits, i: bits + F.when(
            F.get(signs, w * WORD + i) == sign, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))

    distinct = F.array_distinct(signs)
    words = F.sequence(F.lit(0), F.floor((size - 1) / WORD).cast("int"))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda sign: F.transform(words, lambda w: word(sign, w))))


def common_length(masks: Column, text: str) -> Column:
    """Longest common subsequence of ``text`` and the one the masks are of, a word of signs at a time.

    A zero bit says that the common subsequence grows at this sign; adding the
    matching ones to the vector moves the zeros down to the first match.
    """
    all_ones = F.lit((1 << WORD) - 1)
    first = F.transform(F.element_at(F.map_values(masks), 1), lambda _: all_ones)

    def added(vector: Column, mask: Column) -> Column:
        def word(done: Column, i: Column) -> Column:
            now = F.get(vector, i)
            hit = now.bitwiseAND(F.get(mask, i))
            total = now + hit + done["carry"]
            return F.struct(
                F.shiftright(total, WORD).alias("carry"),
                F.concat(done["words"], F.array(total.bitwiseOR(now - hit).bitwiseAND(all_ones))).alias("words"))

        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("words"))
        return F.aggregate(F.sequence(F.lit(0), F.size(vector) - 1), start, word, lambda done: done["words"])

    def step(vector: Column, sign: Column) -> Column:
        mask = F.try_element_at(masks, sign)
        return F.when(mask.isNull(), vector).otherwise(added(vector, mask))

    return F.aggregate(_signs(text), first, step, lambda vector: F.aggregate(
        vector, F.lit(0), lambda n, word: n + WORD - F.bit_count(word)))


def _first_pairs(tokens: Column, many: Column) -> Column:
    """Keys of all pairs among the first tokens in a fixed order, rare ones first; ``many``
    is their number. Repeated tokens are told apart by their turn."""

    def numbered(token: Column, at: Column) -> Column:
        nth = F.size(F.filter(F.slice(tokens, 1, at + 1), lambda x: x == token))
        rank = F.aggregate(_signs(token), F.lit(0), lambda sum_, sign: sum_ + F.call_function("instr", F.lit(COMMON_LAST), sign))
        return F.struct(rank.alias("rank"), F.concat(token, nth.cast("string")).alias("token"))

    ordered = F.transform(F.array_sort(F.transform(tokens, numbered)), lambda t: t["token"])
    kept = F.slice(ordered, 1, many)
    return F.get(F.transform(F.array(kept), lambda k: F.flatten(F.transform(k, lambda a, i: F.transform(
        F.slice(k, i + 2, F.size(k)), lambda b: F.concat_ws("|", F.lit("2"), a, b))))), F.lit(0))


def signatures(texts: DataFrame, text: str, threshold: float) -> DataFrame:
    """Adds ``key``: texts that match at the threshold share one."""
    t, size = threshold, F.length(text)
    least_common = F.ceil(size * (t / (2 - t)) - 1e-9).cast("int")
    signs = _signs(text)
    pairs = F.concat(
        _first_pairs(signs, size - least_common + 2),
        F.when(least_common < 2, F.transform(F.array_distinct(signs), lambda x: F.concat(F.lit("1|"), x))).otherwise(F.array().cast("array<string>")))
    gain = 1.5 * t - 1
    if gain > 0:
        # Texts of at least this length share two neighbouring pairs of signs with any match as long.
        long_enough = ceil(3 * (2 - t) / (2 * gain) - 1e-9)
        shared = F.ceil(size * (2 * gain / (2 - t)) - 1 - 1e-9).cast("int")
        neighbours = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(text, i, F.lit(2)))
        longer = _first_pairs(neighbours, size - 1 - shared + 2)
        pairs = F.when(size < long_enough, pairs).when(least_common < long_enough, F.concat(pairs, longer)).otherwise(longer)
    return texts.withColumn("key", F.explode(F.array_distinct(pairs)))


def match_texts(names: DataFrame, queries: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs (query_text, name_text, score) at or above a threshold.

    Both inputs have one column ``text`` of normalized names.
    """
    names = names.select(F.col("text").alias("name_text")).filter("name_text <> ''").distinct()
    queries = queries.select(F.col("text").alias("query_text")).filter("query_text <> ''").distinct()
    both = F.length("query_text") + F.length("name_text")
    reach = 2 * F.least(F.length("query_text"), F.length("name_text")) >= threshold * both - 1e-9
    return (
        signatures(names, "name_text", threshold).join(signatures(queries, "query_text", threshold), "key").filter(reach)
        .select("query_text", "name_text").distinct()
        .join(queries.withColumn("masks", sign_masks("query_text")), "query_text")
        .withColumn("score", 2 * common_length(F.col("masks"), "name_text") / both).drop("masks")
        .filter(F.col("score") >= threshold - 1e-9)
    )


def _match(names: DataFrame, keys: Sequence[str], queries: DataFrame, threshold: float) -> DataFrame:
    """Best score of each (query, key); names are normalized and matched once."""
    named = names.select(*keys, normalized("name").alias("name_text"))
    asked = queries.select("query", normalized("query").alias("query_text")).distinct()
    pairs = match_texts(
        named.select(F.col("name_text").alias("text")), asked.select(F.col("query_text").alias("text")), threshold
    )
    return (
        pairs.join(asked, "query_text").join(named, "name_text")
        .groupBy("query", *keys).agg(F.max("score").alias("score"))
    )


def _bare(key: str) -> Column:
    """A key without its feed's prefix."""
    return F.when(F.startswith(key, FEED), F.substring(key, F.length(FEED) + 1, F.length(key)))


def match_stops(stops: DataFrame, queries: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Stops whose id, with or without the feed's prefix, or name resembles each
    query; ``queries`` has a column ``query``."""
    names = stops.select(*STOP, F.explode(F.array("stop_id", _bare("stop_id"), "stop_name")).alias("name"))
    return _match(names.filter("name is not null"), STOP, queries, threshold)


def match_routes(routes: DataFrame, queries: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Routes whose id, with or without the feed's prefix, short or long name resembles each query."""
    names = routes.select(
        *ROUTE, F.explode(F.array("route_id", _bare("route_id"), "route_short_name", "route_long_name")).alias("name")
    )
    return _match(names.filter("name is not null"), ROUTE, queries, threshold)


def best_match(matches: DataFrame, key: str) -> DataFrame:
    """Best match per query and feed."""
    return G.top_per(matches, ["query", FEED], [F.desc("score"), key])


def stop_streets(stops: DataFrame) -> DataFrame:
    """Street roots named in a stop: parts of the name without suffix words."""
    bare = F.regexp_replace(F.lower("stop_name"), r"\([^)]*\)", " ")
    part = F.explode(F.split(bare, r"&|/|@| and | at "))
    root = F.trim(F.regexp_replace("part", rf"\b({STREET_WORDS}|mb)\b\.?", " "))
    return (
        stops.select(*STOP, part.alias("part"))
        .select(*STOP, F.regexp_replace(root, r"\s+", " ").alias("name"))
        .filter("name <> ''").distinct()
    )


def stops_on_street(stops: DataFrame, queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Stops one of whose streets resembles each query."""
    return _match(stop_streets(stops), STOP, queries, threshold)


def _attached(scored: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every crossing with every stop of the kinds it matches. A lot of stops is one row, which is
    unfolded last; tasks are sized by the pairs that come out, as the rows that go in are few."""
    sizes = kinds.groupBy("streets").agg(F.count("*").alias("n_stops")) \
        .join(scored.groupBy("streets").agg(F.count("*").alias("n_crossings")), "streets")
    sizes = written(sizes)
    pairs = sizes.agg(F.sum(F.col("n_stops").cast("double") * F.col("n_crossings"))).first()[0] or 0
    tasks, meet = max(1, ceil(pairs / TASK_PAIRS)), ["streets", "_stops", "_crossings"]
    if tasks > 1:
        # With fewer, the join would deal the lots anew, by their size.
        tasks = max(tasks, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lots = {side: F.ceil(F.col(f"n{side}") / LOT).cast("int") for side in meet[1:]}
    dealt = lambda side, *cols: F.pmod(F.xxhash64(*cols), lots[side]).cast("int").alias(side)
    copied = lambda side: F.explode(F.sequence(F.lit(0), lots[side] - 1)).alias(side)
    folded = (
        kinds.join(sizes, "streets").select("streets", dealt("_stops", *STOP), "n_crossings", F.struct(*STOP).alias("stop"))
        .groupBy("streets", "_stops", "n_crossings").agg(F.collect_list("stop").alias("lot"))
        .select("streets", "_stops", copied("_crossings"), "lot").repartition(tasks, *meet)
    )
    asked = (
        scored.join(sizes, "streets").select("streets", copied("_stops"), dealt("_crossings", "crossing_id"), "crossing_id", "score")
        .repartition(tasks, *meet)
    )
    # Merged, so that one crossing after the other is met by a lot, and no task holds the pairs of two lots.
    return asked.join(folded.hint("merge"), meet).select("crossing_id", "score", F.inline("lot")).select("crossing_id", *STOP, "score")


def stops_at_intersection(stops: DataFrame, crossings: DataFrame, threshold: float = 0.8, places: int | None = None) -> DataFrame:
    """Stops where both streets of a crossing match, on different parts of the name.

    ``crossings``: (crossing_id, street_a, street_b). Scores are rounded to
    ``places``, if given, before the stops are attached.
    """
    spelled = written(crossings.select("crossing_id", "street_a", "street_b").distinct())
    asked = spelled.select(F.explode(F.array("street_a", "street_b")).alias("query")).distinct()
    streets = stop_streets(stops)
    # Stops that name the same streets match the same crossings: a class holds the streets of one kind of stop.
    known = streets.filter(F.col(FEED).isNotNull() & F.col("stop_id").isNotNull())
    kinds = written(known.groupBy(*STOP).agg(F.sort_array(F.collect_list("name")).alias("streets")))
    classes = kinds.select("streets").distinct()
    parts = classes.select("streets", F.explode("streets").alias("street")).select(
        "streets", "street", normalized("street").alias("name_text"))
    texts = asked.select("query", normalized("query").alias("query_text"))
    pairs = match_texts(
        parts.select(F.col("name_text").alias("text")), texts.select(F.col("query_text").alias("text")), threshold
    )
    hits = pairs.join(texts, "query_text").join(parts, "name_text").select("query", "streets", "street", "score")
    side = lambda n: hits.select(F.col("query").alias(f"street_{n}"), "streets", F.col("street").alias(f"on_{n}"), F.col("score").alias(f"score_{n}"))
    named = spelled.select("street_a", "street_b").distinct()
    matched = (
        named.join(side("a"), "street_a").join(side("b"), ["street_b", "streets"])
        .filter("on_a <> on_b")
        .groupBy("street_a", "street_b", "streets").agg(F.max(F.col("score_a") + F.col("score_b")).alias("score"))
    )
    # A crossing counts once for each of its ids, at the best score of the streets it stands with.
    scored = spelled.join(matched, ["street_a", "street_b"]).groupBy("crossing_id", "streets").agg(F.max("score").alias("score"))
    if places is not None:
        scored = scored.withColumn("score", F.round("score", places))
    return _attached(written(scored), kinds)
