from __future__ import annotations

import pytest

from shoplytic.llm import components, cotraining, katz, near_duplicates

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def no_waiting(monkeypatch):
    """Small tests need not wait until shuffle files are gone."""
    for module in (components, cotraining, katz, near_duplicates):
        monkeypatch.setattr(module, "release_shuffles", lambda spark: None)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples; the rest is null."""

    def make(rows):
        full = [
            (r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1]))
            for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and blank texts, repeated rows, ties, a very long text."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"), (5, "One"),
        (6, "a b c d e f g"), (7, "a b c d e f g"), (8, long), (9, long + " end"), (None, "lost"),
        (10, "été   naïve"),
    ]


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
