from __future__ import annotations

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, fp string, score string"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text[, source[, lang]]) rows, with further columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, KIND)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and blank texts, ties and repeated rows, a long text."""
    return docs([(1, None, None, None), (None, "a b c", "s"), (2, "", "s"), (3, " \n", "s"), (4, "a b c", None), (4, "a b c", None), (5, "word " * 30_000, "t"), (None, None, None)])


@pytest.fixture
def none(docs):
    return docs([(1, "x", "s")]).where("doc_id < 0")
