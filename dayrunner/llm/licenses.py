"""Licence scans: windows of words classified by n-grams, confirmed against templates.

The words of a text are numbered through, whatever lines and sentences they stand
in. A template is confirmed where a window as long as the template holds at least
CONFIRMED of its different words; so the window holds one of its anchors, the
words of the template that are rarest in the corpus and more than can be missing.
Texts without any anchor are passed over; around every anchor in the others the
window with most of the template's words is taken. It goes through a logistic
regression on sparse word 1- and 2-grams, trained on the templates, on pieces of
them, and on three of four of all paragraphs of the corpus as the unknown class:
those with the same grams are one example that weighs as much as they. The least
probability to name a family is calibrated on every fourth of them, held out. A family counts where the classifier names it and a template of the
family confirms it; so families that share their wording are told apart by the
classifier. Comment marks are no words, so a notice may be wrapped in any way.

Everything is DataFrame expressions and Spark's own estimators; only texts with an
anchor are moved. Which words are anchors is counted over all documents; it
decides what is passed over quickly, never what is found. Defined cases: a
null text is empty and has no paragraphs. Rows that repeat are scanned each on
its own. A null id stays. Equal probabilities: the family that sorts first; equal
windows: the first. Very long texts are scanned whole, in time proportional to
their length and their anchors. An empty table gives no rows. Further columns of
``docs`` are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrunner.llm.common import id_and_text, prepared
from dayrunner.session import written

UNKNOWN = "unknown"
CONFIRMED = 0.6
# So many examples the unknown class weighs as at most, beside the templates; how many paragraphs it has is not bounded.
UNKNOWN_WEIGHT = 3_000
FALSE_ALARMS = 0.001
LEAST_PROBABILITY = 0.5
# Weights are counted in whole parts of one example, so that sums don't depend on their order.
UNIT = 1_000_000
# Different examples a task of the training holds, and steps of a probability it is calibrated to.
TASK_EXAMPLES = 250_000
STEPS = 10_000

# Sentences of well-known licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "artistic": (
        "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "Released under the BSD License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License.",
    ),
    "lgpl": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain.",
        "Released into the public domain under the CC0 1.0 Universal dedication.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "wtfpl": (
        "as published by Sam Hocevar under the terms of the Do What The Fuck You Want To Public License, Version 2",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.",
    ),
}
FAMILIES = (UNKNOWN, *TEMPLATES)
PARAGRAPH = r"(?<=[.!?])[\x20\x09-\x0D]+|\n+"
OUTSIDE_WORDS = r"[^a-z0-9.+-]+"
# The same words as matches: dots belong to a word only inside it. Possessive, so that it never goes back.
WORD = r"[a-z0-9+-]++(?:\.++[a-z0-9+-]++)*+"


def words_of(text: str) -> list[str]:
    return [w for w in (p.strip(".") for p in re.split(OUTSIDE_WORDS, text.lower())) if w]


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def anchors_by_template(counts: dict[str, int] | None = None) -> list[tuple[str, str, list[str]]]:
    """family, template, and the words of which every window that it confirms holds at least one:
    its rarest ones by these counts, of equally rare ones words that are hardly part of others, then those
    that most templates have."""
    texts = [(family, text) for family, held in TEMPLATES.items() for text in held]
    spread = Counter(chain.from_iterable(set(words_of(text)) for _, text in texts))
    out = []
    for family, text in texts:
        words = sorted(set(words_of(text)), key=lambda w: ((counts or {}).get(w, 0), len(w) < 5, -spread[w], -len(w), w))
        out.append((family, text, words[:math.floor((1 - CONFIRMED) * len(words) + 1e-9) + 1]))
    return out


def anchors(counts: dict[str, int] | None = None) -> list[str]:
    return sorted(set(chain.from_iterable(words for _, _, words in anchors_by_template(counts))))


def vocabulary(pairs: bool = True) -> list[str]:
    """The words of the templates, with ``pairs`` also their pairs of neighbours."""
    texts = [words_of(t) for t in chain.from_iterable(TEMPLATES.values())]
    return sorted(set(chain.from_iterable([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if pairs)] for w in texts)))


def counted_words(docs: DataFrame) -> dict[str, int]:
    """How many of all documents have each word of the templates."""
    found = docs.select(F.explode(F.array_intersect(words_column(F.col("text")), F.array(*map(F.lit, vocabulary(pairs=False))))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def overlap(words: Column, family: Column | None = None) -> Column:
    """The largest share of a template's words among ``words``; of one family, if given."""
    templates = F.array(*[
        F.struct(F.lit(f).alias("family"), F.array(*[F.lit(w) for w in sorted(set(words_of(t)))]).alias("words"))
        for f, texts in TEMPLATES.items() for t in texts])
    if family is not None:
        templates = F.filter(templates, lambda t: t["family"] == family)
    return F.coalesce(F.array_max(F.transform(
        templates, lambda t: F.size(F.array_intersect(t["words"], words)) / F.size(t["words"]))), F.lit(0.0))


def grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def known_grams(words: Column) -> Column:
    """Those of the words' ``grams`` that the templates have, each once and sorted."""
    singles, terms = vocabulary(pairs=False), vocabulary()

    def of(held: Column) -> Column:
        pairs = F.zip_with(held, F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_sort(F.array_distinct(F.filter(F.concat(held, pairs), lambda x: x.isin(terms))))

    # Words of no template are null, so no pair is put together of them.
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.when(w.isin(singles), w))), of), F.lit(0))


def _examples(spark: SparkSession) -> DataFrame:
    """Templates with their families, and halves of them too short to confirm as unknown."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            rows += [(family, text), (family, " ".join(words[:-1]) if len(words) > 4 else text), (family, text + " and so on")]
            cut = max(1, math.floor(len(words) * 0.4))
            rows += [(UNKNOWN, " ".join(words[:cut])), (UNKNOWN, " ".join(words[-cut:]))]
    return spark.createDataFrame(rows, "family string, paragraph string")


def near_words(words: Column, rare: list[str]) -> Column:
    """Whether a template is confirmed by these words; without an anchor none can be."""
    return F.arrays_overlap(words, F.array(*map(F.lit, rare))) & (overlap(words) >= CONFIRMED)


def near_template(paragraph: Column, rare: list[str]) -> Column:
    """Whether a template is confirmed by the paragraph's words, which are bound once, as the
    templates are compared one by one."""
    return F.exists(F.array(words_column(paragraph)), lambda words: near_words(words, rare))


def _unknown(paragraphs: DataFrame, rare: list[str]) -> DataFrame:
    """Written: known (grams), aside, weight (in parts of an example) of all paragraphs that no template comes near to."""
    known = F.col("known") if "known" in paragraphs.columns else known_grams(words_column(F.col("paragraph")))
    weight = F.col("weight") if "weight" in paragraphs.columns else F.lit(UNIT).cast("long")
    alike = (
        paragraphs.select(known.alias("known"), (F.pmod(F.xxhash64("doc_id", "place"), F.lit(4)) == 0).alias("aside"), weight.alias("weight"))
        .groupBy("known", "aside").agg(F.sum("weight").alias("weight"))
    )
    # Templates have no other words than known ones.
    return written(alike.filter(F.col("known").isNotNull() & ~near_words(F.col("known"), rare)).sortWithinPartitions("known", "aside"))


def _edge(held: DataFrame) -> float:
    """The least probability that at most FALSE_ALARMS of the weight lies above, from LEAST_PROBABILITY on, to one of STEPS; held: p, weight."""
    total = held.agg(F.sum("weight")).first()[0] or 0
    steps = held.filter(F.col("p") >= LEAST_PROBABILITY).groupBy(F.floor(F.col("p") * STEPS).alias("step")) \
        .agg(F.sum("weight").alias("weight"), F.max("p").alias("p")).orderBy(F.desc("step")).collect()
    above = 0
    for r in steps:
        above += r["weight"]
        if above > FALSE_ALARMS * total:
            return r["p"]
    return 0.0


def learn(paragraphs: DataFrame, rare: list[str] | None = None) -> tuple[PipelineModel, float]:
    """The fitted classifier, and the least probability to name a family.

    ``paragraphs`` has doc_id, place and paragraph, or known in its place, the
    ``known_grams`` of its words; it may have weight, in parts of UNIT to an example.
    All of those that no template comes near to are unknown examples: every fourth by
    id and place is for the calibration, the others are for the training.
    ``rare`` has the anchors; which ones changes time, never results.
    """
    spark = prepared(paragraphs.sparkSession)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    strange = _unknown(paragraphs, anchors() if rare is None else rare)
    size, total = strange.agg(F.count("*"), F.sum("weight")).first()
    one = min(1.0, UNKNOWN_WEIGHT * UNIT / (total or 1)) / UNIT
    train = _examples(spark).select("family", grams(words_column(F.col("paragraph"))).alias("grams"), F.lit(1.0).alias("weight")) \
        .unionByName(strange.filter("not aside").select(F.lit(UNKNOWN).alias("family"), F.col("known").alias("grams"), (F.col("weight") * one).alias("weight")))
    counted = CountVectorizerModel.from_vocabulary(vocabulary(), "grams", outputCol="counts", minTF=1.0)
    counted.setBinary(True)
    flow = Pipeline(stages=[
        counted, Normalizer(inputCol="counts", outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, labelCol="label", weightCol="weight"),
    ])
    labelled = train.coalesce(max(2, size // TASK_EXAMPLES)).withColumn("label", (F.array_position(names, F.col("family")) - 1).cast("double"))
    model = flow.fit(labelled)
    held = model.transform(strange.filter("aside").withColumnRenamed("known", "grams")).select(
        F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1)).alias("p"), "weight")
    return model, max(LEAST_PROBABILITY, min(0.99, _edge(held)))


def classify(windows: DataFrame, model: PipelineModel, least: float) -> DataFrame:
    """Windows whose template's family the classifier names, with its probability."""
    names = F.array(*[F.lit(f) for f in FAMILIES[1:]])
    rows = model.transform(windows.withColumn("grams", grams(F.col("words"))))
    rows = rows.withColumn("_named", F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1)).withColumn("_p", F.array_max("_named"))
    named = F.element_at(names, F.array_position("_named", F.col("_p")).cast("int"))
    return rows.filter((F.col("_p") >= least) & (named == F.col("family"))).select(*windows.columns, F.col("_p").alias("chance"))


def _windows(marked: DataFrame, chosen: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Where templates are confirmed: doc_id, text_key, family, overlap, place, last, words."""
    templates = F.array(*[
        F.struct(F.lit(family).alias("family"), F.array(*map(F.lit, sorted(set(words_of(text))))).alias("held"), F.lit(len(words_of(text))).alias("long"),
                 F.array(*map(F.lit, anchors_)).alias("anchors"))
        for family, text, anchors_ in chosen])
    longest = max(len(words_of(text)) for _, text, _ in chosen)
    every = sorted(set(chain.from_iterable(a for _, _, a in chosen)))
    tokens = F.flatten(F.transform("all", lambda s: F.transform(
        words_column(s["paragraph"]), lambda w: F.struct(s["place"].alias("place"), w.alias("word")))))
    spots = F.filter(F.transform("tokens", lambda t, k: F.struct(k.alias("at"), t["word"].alias("word"))), lambda t: t["word"].isin(every))
    around = F.transform("spots", lambda t: F.struct(
        t["word"].alias("word"), F.slice("tokens", F.greatest(t["at"] - longest + 2, F.lit(1)), 2 * longest - 1).alias("near")))
    near = (
        marked.filter("all is not null").select("doc_id", "text_key", "all").withColumn("tokens", tokens).withColumn("spots", spots)
        .select("doc_id", "text_key", F.explode(around).alias("s")).select("doc_id", "text_key", "s.word", "s.near")
        .withColumn("t", F.explode(F.filter(templates, lambda t: F.array_contains(t["anchors"], F.col("word")))))
        .withColumn("seen", F.transform("near", lambda x: x["word"]))
        .filter(F.size(F.array_intersect("t.held", "seen")) >= CONFIRMED * F.size("t.held") - 1e-9)
    )
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("seen")), lambda p: F.struct(
        F.size(F.array_intersect("t.held", F.slice("seen", p, F.col("t.long")))).alias("n"), (-p).alias("back"))))
    # Cut to the template's own first and last word in the window.
    mine = F.transform(F.slice("near", -F.col("best.back"), F.col("t.long")), lambda x: F.struct(
        x["place"].alias("place"), x["word"].alias("word"), F.array_contains("t.held", x["word"]).alias("own")))
    flags = F.transform("mine", lambda x: x["own"])
    first = F.array_position(flags, F.lit(True)).cast("int")
    last = F.size("mine") - F.array_position(F.reverse(flags), F.lit(True)).cast("int") + 1
    return (
        near.withColumn("best", best).filter(F.col("best.n") >= CONFIRMED * F.size("t.held") - 1e-9)
        .withColumn("mine", mine).withColumn("mine", F.slice("mine", first, last - first + 1))
        .select("doc_id", "text_key", "t.family", (F.col("best.n") / F.size("t.held")).alias("overlap"), F.element_at("mine", 1)["place"].alias("place"),
                F.element_at("mine", -1)["place"].alias("last"), F.transform("mine", lambda x: x["word"]).alias("words"))
        .distinct()
    )


def _apart(found: Column) -> Column:
    """Of a sorted array of notices, those that share no paragraph with one of their family taken before."""
    empty = F.slice(found, 1, 0)
    return F.aggregate(found, empty, lambda kept, x: F.when(F.exists(kept, lambda k: (k["family"] == x["family"]) & (
        k["place"] <= x["last"]) & (x["place"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(x))))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[tuple[str, str, list[str]]]]:
    """Written: doc_id, text_key, n_paragraphs, terms (place and known grams of every paragraph), all
    (place and paragraph, where there is an anchor); and the anchors."""
    prepared(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    chosen = anchors_by_template(counted_words(rows))
    every = sorted(set(chain.from_iterable(words for _, _, words in chosen)))
    numbered = F.transform(F.split("text", PARAGRAPH, -1), lambda p, k: F.struct(k.alias("place"), p.alias("paragraph")))
    filled = F.filter(numbered, lambda s: F.btrim(s["paragraph"], F.lit(" \t\x0b\x0c\r")) != "")
    terms = F.transform("paragraphs", lambda s: F.struct(s["place"].alias("place"), known_grams(words_column(s["paragraph"])).alias("known")))
    return written(
        rows.withColumn("paragraphs", filled).withColumn("terms", terms).select(
            "doc_id", F.xxhash64("text").alias("text_key"), F.size("paragraphs").cast("long").alias("n_paragraphs"), "terms",
            F.when(F.exists("terms", lambda s: F.exists(s["known"], lambda w: w.isin(every))), F.col("paragraphs")).alias("all"))
    ), chosen


def confirmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The windows that templates confirm, before the classifier: doc_id, text_key, family, overlap, place, last, words."""
    return _windows(*_marked(docs, id_col, text_col))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_paragraphs, licences (place, family, probability, paragraph), n_unknown.

    A paragraph is a line or sentence; a notice begins at ``place``, and its
    ``paragraph`` is all of those it stands in. ``n_unknown`` counts the other
    paragraphs with an anchor.
    """
    marked, chosen = _marked(docs, id_col, text_col)
    every = sorted(set(chain.from_iterable(words for _, _, words in chosen)))
    key = ["doc_id", "text_key"]
    windows = written(_windows(marked, chosen))
    anchored = F.filter("all", lambda s: F.exists(words_column(s["paragraph"]), lambda w: w.isin(every)))
    parts = marked.select(*key, F.col("all").isNotNull().alias("near"), "n_paragraphs", F.explode("terms").alias("s")).select("*", "s.*")
    covered = windows.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), F.explode(F.sequence("place", "last")).alias("of_place"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    # Notices stand only in texts with an anchor, so the others are not moved.
    others = parts.filter("near").join(covered.distinct(), same & (F.col("place") == F.col("of_place")), "left_anti").unionByName(parts.filter("not near"))
    # A text's paragraphs weigh as one example together, and those with an anchor as one more each.
    weight = F.greatest(F.floor(F.lit(UNIT) / F.col("n_paragraphs")), F.lit(1)) + F.when(F.exists("known", lambda w: w.isin(every)), F.lit(UNIT)).otherwise(F.lit(0))
    model, least = learn(others.select("doc_id", "place", "known", weight.cast("long").alias("weight")), every)
    found = F.struct((-F.col("overlap")).alias("rank"), (F.col("last") - F.col("place")).alias("size"), "place", "last", "family", F.col("chance").alias("probability"))
    told = classify(windows, model, least).groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")) \
        .agg(F.sort_array(F.collect_list(found)).alias("found")).withColumn("found", _apart(F.col("found")))
    left = F.filter(F.transform(F.coalesce(anchored, F.array().cast("array<struct<place:int,paragraph:string>>")), lambda s: s["place"]),
                    lambda p: ~F.exists("found", lambda s: p.between(s["place"], s["last"])))
    text = lambda s: F.array_join(F.transform(F.filter("all", lambda x: x["place"].between(s["place"], s["last"])), lambda x: x["paragraph"]), " ")
    none = F.array().cast(told.schema["found"].dataType)
    return marked.join(told, same, "left").withColumn("found", F.coalesce("found", none)).select(
        "doc_id", "n_paragraphs", F.sort_array(F.transform("found", lambda s: F.struct(
            s["place"].alias("place"), s["family"].alias("family"), s["probability"].alias("probability"), text(s).alias("paragraph")))).alias("licences"),
        F.size(left).cast("long").alias("n_unknown"))
