"""Small tables with nulls, empty and very long texts, ties and repeated rows, and clashing column names."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, spans string"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))


def documents(spark, texts):
    """(doc_id, text) rows with every column of documents and others whose names operators use themselves."""
    rows = [(i, t, None if i is None else "en", None, None if t is None else len(t), 7, 0.5, "s") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts: documents(spark, texts)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, an empty and a blank text, a very long one, ties, repeated rows and ids."""
    return [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "One"), (6, "one"), (7, "Same text here again"), (7, "Same text here again"), (8, "Same text here again"), (9, "Ünïcode — 漢字 text"), (None, "no id at all"), (9, "other text of one id")]
