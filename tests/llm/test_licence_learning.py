"""The unknown class is learned from every paragraph, however many there are."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from dayrunner.llm import licenses

NEAR_MISS = "the apache version 2.0"


def late(i: int) -> bool:
    """Whether an id has one of the largest hashes, which a draw of 3,000 by hash passed over."""
    return int(hashlib.md5(f"{i}/0/unknown".encode()).hexdigest()[:13], 16) / 16**13 > 0.8


def chances(model, spark):
    row = spark.createDataFrame([(NEAR_MISS,)], "paragraph string")
    row = row.select(licenses.grams(licenses.words_column(F.col("paragraph"))).alias("grams"))
    return dict(zip(licenses.FAMILIES, model.transform(row).first()["probability"], strict=True))


def test_every_paragraph_is_learned_from(spark):
    """Paragraphs that come after 3,000 others in the order of the draw there was are learned from as well."""
    texts = [(i, 0, NEAR_MISS if late(i) else "the plain prose of an author") for i in range(6_000)]
    assert sum(not late(i) for i in range(6_000)) > 4_500
    model, least = licenses.learn(spark.createDataFrame(texts, "doc_id long, place int, paragraph string"))
    assert chances(model, spark)[licenses.UNKNOWN] > 0.9 and least >= licenses.LEAST_PROBABILITY


def test_alike_paragraphs_weigh_as_many_as_they_are(spark):
    texts = ["The notes of the MIT", "notes of the MIT, of the.", "plain", "Released under the MIT License.", None, ""]
    paragraphs = spark.createDataFrame([(i, i % 3, texts[i % 6]) for i in range(600)] + [(None, 0, "plain")], "doc_id long, place int, paragraph string")
    got = licenses._unknown(paragraphs, licenses.anchors()).groupBy("known").agg(F.sum("weight").alias("n")).collect()
    known = {" ".join(r["known"]): r["n"] // licenses.UNIT for r in got}
    assert known == {"mit of of the the the mit": 200, "": 201}


def test_known_grams_are_those_the_classifier_reads(spark):
    texts = ["", "Licensed to you under the MIT License, License", "a b c", *(t for held in licenses.TEMPLATES.values() for t in held)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.words_column(F.col("t")).alias("w"))
    terms = set(licenses.vocabulary())
    for r in df.select(licenses.known_grams(F.col("w")).alias("known"), licenses.grams(F.col("w")).alias("all")).collect():
        assert r["known"] == sorted(set(r["all"]) & terms)


def test_false_alarms_are_counted_over_all_weights(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 5), (0.1, 1_993)]
    assert licenses._edge(spark.createDataFrame(rows, "p double, weight long")) == 0.7
    assert licenses._edge(spark.createDataFrame(rows[3:], "p double, weight long")) == 0.0
    assert licenses._edge(spark.createDataFrame([], "p double, weight long")) == 0.0
