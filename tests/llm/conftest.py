from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, kept boolean, probability double, _source string"


@pytest.fixture
def docs_of(spark):
    """Documents with columns that clash with the operators' own names."""

    def make(rows):
        filled = [(i, t, lang, source, 0.5, True, 0.1, "x") for i, t, lang, source in rows]
        return spark.createDataFrame(filled, SCHEMA)

    return make


@pytest.fixture
def odd(docs_of):
    """Nulls, empty texts, repeated rows and a very long text."""
    return docs_of([
        (1, "Ein Text mit Worten.", "de", "a"), (1, "Ein Text mit Worten.", "de", "a"), (2, None, None, None), (3, "", "en", "a"),
        (None, "No id here, some words.", "en", "b"), (None, None, "en", None), (4, "   \n\t ", None, "b"), (5, "12 34 !!", "en", "b"),
        (6, "many words " * 20_000, "en", "c"), (7, "x" * 100_000, "en", "c"), (8, "1" * 50_000, None, None), (9, "日本語 🙂 ñ", "ja", "c"),
    ])


@pytest.fixture
def none(docs_of):
    return docs_of([])
