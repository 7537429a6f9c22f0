"""Words of the templates are counted over every document."""

from __future__ import annotations

from collections import Counter

from dayrunner.llm import licenses


def test_every_document_counts(spark, docs_of):
    texts = ["Plain words.", "..Version. 2.0.. the-the (MIT) mit. license...", None, "", "AFFERO\n\n.affero. ..éaffero", "http://www.apache.org/licenses/LICENSE-2.0."]
    docs = docs_of([(i, t, "en", "a") for i, t in enumerate(texts * 500)]).coalesce(1)
    vocabulary = {w for held in licenses.TEMPLATES.values() for t in held for w in licenses.words_of(t)}
    want = Counter(w for t in texts * 500 for w in set(licenses.words_of(t or "")) & vocabulary)
    assert licenses.counted_words(docs) == dict(want) and want["affero"] == 500


ODD = [
    "", None, "...", "a.b", "..A..b. c.", "v. 2.0.", "x." * 3 + "y", "-.-", "+.", "é.mit.é", "MITK", "a.b." * 60_000, "-" * 300_000, "." * 300_000 + "z",
]


def test_words_as_matches_equal_words_split(spark, docs_of):
    docs = docs_of([(i, t, "en", "a") for i, t in enumerate(ODD)])
    got = {r["doc_id"]: r["w"] for r in docs.select("doc_id", licenses.words_column(docs["text"]).alias("w")).collect()}
    assert got == {i: None if t is None else licenses.words_of(t) for i, t in enumerate(ODD)}


def test_words_are_split_once_a_paragraph(spark, docs_of):
    """Passing over paragraphs without an anchor gives the same, and no template splits the text anew."""
    held = [t for texts in licenses.TEMPLATES.values() for t in texts]
    texts = [*held, *(" ".join(t.split()[k:]) for t in held for k in (1, 2, 5)), "all of the rights", "rights reserved", "plain", "", "MIT. License, released"]
    docs = docs_of([(i, t, "en", "a") for i, t in enumerate(texts)])
    text = docs["text"]
    rare = licenses.anchors(licenses.counted_words(docs))
    rows = docs.select("text", licenses.near_template(text, rare).alias("a"), licenses.near_template(text, licenses.anchors()).alias("b"),
                       (licenses.overlap(licenses.words_column(text)) >= licenses.CONFIRMED).alias("want")).collect()
    assert all(r["a"] == r["b"] == r["want"] for r in rows) and {r["want"] for r in rows} == {True, False}
    paragraphs = docs.select("doc_id", text.alias("paragraph"))
    plan = paragraphs.filter(~licenses.near_template(paragraphs["paragraph"], rare))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
