from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayrunner.operators import matching as N
from dayrunner.operators import retrieval as R
from tests.conftest import rows


def common(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], last + 1 if x == y else max(line[j], line[j - 1])
    return line[-1]


def matched(spark, names, queries, threshold):
    return {(r.query_text, r.name_text): r.score for r in N.match_texts(
        spark.createDataFrame([(n,) for n in names], "text string"), spark.createDataFrame([(q,) for q in queries], "text string"), threshold
    ).collect()}


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.7, 0.8, 0.85, 1.0])
def test_matching_equals_brute_force(spark, threshold):
    names = ["green main", "gren main", "main", "mian", "oak", "oaks", "a", "b", "springfield wright", "sprngfeld wrigt", "x", "ab", "abc", "station"]
    queries = ["green main", "maine", "oka", "aa", "springfield right", "c", "abd", "stations", "a"]
    # Longer than a word of bits, other scripts, and repeated signs.
    random = np.random.default_rng(4)
    for n in (3, 8, 20, 33, 70):
        for _ in range(6):
            text = list(random.choice(list("aabcd e1ñ駅"), n))
            names.append("".join(text))
            for _ in range(int(n * random.uniform(0, 0.5))):
                text[random.integers(len(text))] = random.choice(["", "z", "a", "駅駅"])
            queries.append("".join(text) or "q")
    got = matched(spark, names, queries, threshold)
    score = {(q, n): 2 * common(q, n) / (len(q) + len(n)) for q in queries for n in names}
    want = {pair: s for pair, s in score.items() if s >= threshold - 1e-9}
    assert got == pytest.approx(want)


def test_candidates_are_few(spark):
    """The join on pairs of signs meets a small part of all pairs."""
    random = np.random.default_rng(6)
    words = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(4, 9))) for _ in range(400)]
    names = {" ".join(sorted(random.choice(words, 3))) for _ in range(1500)}
    df = spark.createDataFrame([(n,) for n in names], "t string")
    left, right = N.signatures(df.limit(200), "t", 0.8), N.signatures(df, "t", 0.8)
    pairs = left.alias("l").join(right.alias("r"), "key").select("l.t", F.col("r.t").alias("u")).distinct().count()
    assert pairs < 0.1 * 200 * len(names)


def test_normalized_names(spark):
    df = spark.createDataFrame([("Neil & Springfield (NW Corner)",), ("SPRINGFIELD  neil",)], "x string")
    assert [r.y for r in df.select(N.normalized("x").alias("y")).collect()] == ["neil springfield"] * 2


def test_intersections(spark):
    stops = spark.createDataFrame([
        ("f", "1", "Neil & Springfield (NW Corner)"), ("f", "2", "Neil St / Green Ave"), ("f", "3", "Springfield MB"),
    ], "gtfs_id string, stop_id string, stop_name string")
    asked = spark.createDataFrame([("c", "Niel", "Springfeld"), ("d", "Green", "Neil")], "crossing_id string, street_a string, street_b string")
    assert rows(N.stops_at_intersection(stops, asked, 0.5), "crossing_id", "stop_id") == [("c", "1"), ("d", "2")]


def plain_tokens(text):
    out = []
    for tok in re.findall("[0-9a-z_]+|[぀-ヿ㐀-鿿]+", text.lower()):
        out.append(tok)
        if re.match("[぀-ヿ㐀-鿿]", tok) and len(tok) >= 3:
            out += [tok[i:i + 2] for i in range(min(len(tok) - 1, 20))]
    return out


TEXTS = [
    "Find the busiest stop", "find the busiest route on a Friday", "駅前の停留所を探す", "路線", "運行日 2024_01", "バ" * 25 + " stop",
    "the the the", "Find the busiest stop", "average headway of the route", "!!!", "trips per day; trips per week",
]


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert [r.t for r in df.select(R.tokens("text").alias("t")).collect()] == [plain_tokens(t) for t in TEXTS]


def plain_retrieve(texts, query, k):
    docs = [collections.Counter(plain_tokens(t)) for t in texts]
    df = collections.Counter(t for d in docs for t in d)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vec = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
    size = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    q = vec(collections.Counter(plain_tokens(query)))
    scored = [(round(sum(w * vec(d).get(t, 0) for t, w in q.items()) / (size(q) * size(vec(d))), 10), i) for i, d in enumerate(docs)]
    best = sorted([s for s in scored if s[0] > 0], key=lambda s: (-s[0], s[1]))[:k]
    return [(i, place, round(score, 8)) for place, (score, i) in enumerate(best, 1)]


@pytest.mark.parametrize("k", [1, 2, 4, 20])
def test_retrieval_equals_brute_force(spark, k):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    queries = ["busiest stop", "the route", "停留所", "zzz unknown", "", "trips on friday per day", "路線 the"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    got = collections.defaultdict(list)
    for r in R.retrieve(docs, asked, k).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.doc_id, r.place, round(r.score, 8)))
    assert dict(got) == {i: w for i, q in enumerate(queries) if (w := plain_retrieve(TEXTS, q, k))}


def test_truncation(spark):
    df = spark.createDataFrame([("x" * 30,), ("a" * 5 + " " * 40,)], "t string")
    assert [r.y for r in df.select(R.truncated("t", 30).alias("y")).collect()] == ["x" * 30, "a" * 5 + R.TRUNCATION_MARK]


def test_packing_stops_at_the_first_overflow(spark):
    docs = spark.createDataFrame([(1, "s1", "q", "a" * 50), (2, "s2", "q", "b" * 300), (3, "s3", "q", "c")], "doc_id bigint, source string, kind string, text string")
    hits = spark.createDataFrame([("q", 1, 1, 0.5), ("q", 2, 2, 0.25), ("q", 3, 3, 0.125)], "query_id string, place int, doc_id bigint, score double")
    got = R.packed_messages(hits, docs, budget=200, header="HEAD").first()
    assert got.blocks == 1
    assert got.message == "HEAD\n\n---\nsource: s1\nscore: 0.500\n" + "a" * 50


def test_header_longer_than_the_budget(spark):
    docs = spark.createDataFrame([(1, "s1", "q", "a")], "doc_id bigint, source string, kind string, text string")
    hits = spark.createDataFrame([("q", 1, 1, 0.5)], "query_id string, place int, doc_id bigint, score double")
    got = R.packed_messages(hits, docs, budget=30, header="H" * 40).first()
    assert (got.message, got.blocks) == ("H" * 10 + R.TRUNCATION_MARK, 0)


def worded(spark, n):
    """Texts that all hold "the", one word of twenty, and rare ones; some are equal."""
    rng = random.Random(n)
    texts = [
        " ".join(["the"] * rng.randint(1, 3) + [f"common{rng.randrange(20)}"] + [f"rare{rng.randrange(n // 8)}" for _ in range(rng.randint(3, 9))])
        for _ in range(n)
    ]
    texts[5::50] = [texts[0]] * len(texts[5::50])
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


QUESTIONS = ["the rare3", "the common5 rare1 rare2", "the", "the the common7", "rare4 rare5", "nothing known", "", None, "common1 rare9"]


def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, text string")


@pytest.mark.parametrize("k", [1, 4, 30])
def test_skipping_gives_the_rows_of_the_plain_join(spark, k):
    docs, asked = worded(spark, 240), questions(spark)
    want = rows(R.retrieve(docs, asked, k), "query_id", "doc_id", "place", "score")
    assert rows(R.retrieve_skipping(docs, asked, k), "query_id", "doc_id", "place", "score") == want and want


def test_skipping_without_texts_or_questions(spark):
    docs, asked = worded(spark, 240), questions(spark)
    assert R.retrieve_skipping(docs.limit(0), asked).count() == 0
    assert R.retrieve_skipping(docs, asked.limit(0)).count() == 0


def test_rows_joined_grow_less_than_the_corpus(spark):
    """A word in every text: the plain join meets all of them, the kept blocks few."""
    joined = {}
    for n in (400, 3200):
        index = R.Index(worded(spark, n))
        asked = R._asked(index, questions(spark).filter("query_id = 0"))
        plan = R.block_plan(asked, R.blocked_postings(index, asked), 4).collect()
        joined[n] = sum(r["rows"] for r in plan if not r.skipped), sum(r["rows"] for r in plan)
    (kept, every), (kept_later, every_later) = joined[400], joined[3200]
    assert every_later > 7 * every and kept_later < 4 * kept and kept_later < every_later / 10, joined
