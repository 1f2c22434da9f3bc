from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, gone string, h long"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, source, len(t) if t is not None else None, -1, -2, "x", -3) for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def edge_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    return [
        (1, None, None, None), (None, "a b c d e f", "en", "s"), (2, "", "en", "s"), (3, " \t\n", "en", None), (4, "a b c d e f", "en", "s"), (4, "a b c d e f", "en", "s"),
        (4, "another text with the same id as others", "en", "s"), (5, "é" * 10, None, "t"), (6, "word " * 30000, "en", "t"), (7, "x" * 60000, "en", "u"), (8, "😀 ok\n\n", "de", "s"),
    ]
