from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shoplytic.llm import decontamination as leaks


def _best(item, text):
    """(distance, end) of the substring nearest to the item, by the full table."""
    column = list(range(len(item) + 1))
    best = column[-1], 0
    for at, c in enumerate(text, 1):
        above, column[0] = column[0], 0
        for i in range(1, len(item) + 1):
            above, column[i] = column[i], min(
                column[i] + 1, column[i - 1] + 1, above + (item[i - 1] != c)
            )
        best = min(best, (column[-1], at), key=lambda b: b[0])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bit_parallel_distance(seed):
    pick = random.Random(seed)
    item = "".join(pick.choices("abcé", k=pick.choice([1, 3, 20, 70, 150])))
    text = "".join(pick.choices("abcé", k=pick.randint(0, 60)))
    if seed % 2:
        near = list(item)
        near[pick.randrange(len(near))] = "z"
        text += "".join(near) + text
    assert leaks.Pattern(item).best_end(text) == _best(item, text)


def test_pieces_fill_the_item():
    for size in (1, 2, 9, 100):
        item = "x" * size
        for budget in (0, 1, 5, 99, 200):
            pieces = leaks.pieces_of(item, budget)
            assert "".join(p for _, p in pieces) == item and all(p for _, p in pieces)
            assert len(pieces) == min(budget + 1, size)


def _edit(pick, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = pick.randrange(len(letters))
        what = pick.randrange(3)
        if what == 0:
            letters[at] = "#"
        elif what == 1:
            letters.insert(at, "+")
        else:
            del letters[at]
    return "".join(letters)


def _case():
    pick = random.Random(8)

    def prose(n):
        return " ".join("".join(pick.choices("abcdefgh", k=pick.randint(2, 7))) for _ in range(n))

    items = [(i, prose(pick.randint(8, 40)).capitalize()) for i in range(12)]
    docs = []
    for d in range(150):
        text = prose(40)
        for _ in range(pick.randint(0, 2)):
            _, item = pick.choice(items)
            text += " \n " + _edit(pick, item.upper(), pick.randint(0, 14)) + " " + prose(20)
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("block_chars", [1 << 20, 300])
def test_against_the_full_table(spark, documents, block_chars):
    docs, items = _case()
    expected = {}
    for d, text in docs:
        for i, item in items:
            goal, whole = leaks.normalised(item), leaks.normalised(text)
            distance, end = _best(goal, whole)
            if distance <= int(len(goal) * leaks.ERROR_SHARE):
                expected[(d, i)] = distance, end
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(documents(docs), benchmark, block_chars=block_chars).collect()
    assert len(got) == len(expected) > 50
    for r in got:
        assert expected[(r["doc_id"], r["item_id"])] == (r["distance"], r["end"])
        assert 0 <= r["start"] < r["end"]


def test_odd_rows(spark, documents, odd_texts):
    items = [(1, None), (2, " "), (None, "a b c d e f g"), (4, "w1 x1 w2 x2 w3 x3 w4 x4")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("x", F.lit(1))
    docs = documents(odd_texts)
    got = leaks.find_leaks(docs, benchmark)
    found = sorted((r["doc_id"], r["item_id"] or 0) for r in got.collect())
    assert found == [(6, 0), (7, 0), (8, 4), (9, 4)]
    kept = leaks.without_leaks(docs, got)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(docs, none).collect() == []
    assert leaks.find_leaks(documents([]), benchmark).collect() == []
