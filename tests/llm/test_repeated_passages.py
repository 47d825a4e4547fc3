from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplytic.llm import repeated_passages as passages
from shoplytic.llm.common import window_hashes

W = passages.WINDOW


def _expected(rows):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for at in range(len(words) - W + 1):
            window = tuple(words[at : at + W])
            if i is not None and first.get(window, i) >= i:
                first[window] = i
    found = []
    for i, words in texts:
        gone = [False] * len(words)
        for at in range(len(words) - W + 1):
            if i is not None and first[tuple(words[at : at + W])] < i:
                gone[at : at + W] = [True] * W
        kept = b" ".join(w for w, out in zip(words, gone, strict=True) if not out).decode()
        found.append((i, len(words), sum(gone), kept))
    return sorted(found, key=str)


def _rows(seed):
    pick = random.Random(seed)
    shared = [[f"s{k}x{pick.randrange(40)}" for _ in range(pick.randint(45, 140))] for k in range(9)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(pick.randint(0, 4)):
            words += [f"u{i}x{pick.randrange(10**6)}" for _ in range(pick.randint(0, 60))]
            part = pick.choice(shared)
            low = pick.randrange(0, 30)
            words += part[low : low + pick.randint(20, 120)]
        rows.append((pick.randrange(1000) * 1000 + i, " ".join(words)))
    rows += [(i + 7_000_000, t) for i, t in rows[:20]] + rows[20:25]
    loop = " ".join(f"l{k % 7}" for k in range(160))
    return [*rows, (5, loop), (6, loop + " tail"), (4, loop.upper())]


def _got(df):
    return sorted(
        ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, documents, seed):
    rows = _rows(seed)
    docs = documents(rows).withColumn("hits", F.lit(1)).withColumn("starts", F.lit(1))
    assert _got(passages.remove_repeats(docs)) == _expected(rows)


def test_without_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(passages, "broadcast_if_small", lambda keys, rows=0: keys)
    assert _got(passages.remove_repeats(documents(_rows(4)))) == _expected(_rows(4))


def test_odd_rows(spark, documents, odd_texts):
    long = odd_texts[8][1]
    rows = [*odd_texts, (None, long), (0, long.replace("w5 ", "w5  "))]
    assert _got(passages.remove_repeats(documents(rows))) == _expected(rows)
    assert passages.remove_repeats(documents([])).collect() == []


def test_different_texts_under_one_id(spark, documents):
    def words(name, count):
        return " ".join(f"{name}{k}" for k in range(count))

    shared, own = words("p", 80), words("q", 80)
    rows = [(1, shared), (2, words("x", 30) + " " + shared), (2, own), (2, shared), (3, own)]
    # A third of all rows under one id, each text with a passage of its own or of another row.
    rows += [(9, words(f"a{i}x", 60) + " " + (shared if i % 2 else own)) for i in range(40)]
    rows += [(9, own), (9, own), (None, own)]
    assert _got(passages.remove_repeats(documents(rows))) == _expected(rows)


def test_key_filter_lets_every_key_pass(spark):
    from shoplytic.llm.common import key_filter, maybe_among

    rows = spark.range(-3000, 3000).selectExpr("CASE WHEN id != 7 THEN id END AS a", "id % 5 AS b")
    keys = rows.filter("b = 2 OR a IS NULL")
    found = maybe_among(rows, key_filter(keys, ["a", "b"]), ["a", "b"], "maybe")
    assert found.columns == ["a", "b", "maybe"] and found.count() == 6000
    assert found.filter("(b = 2 OR a IS NULL) AND NOT maybe").count() == 0
    # 1,200 of 2^27 bits are set.
    assert found.filter("maybe").count() < keys.count() + 20


def test_cover_has_every_difference():
    cover = passages.COVER
    found = {(a - b) % passages.PERIOD for a in cover for b in cover}
    assert found == set(range(passages.PERIOD))


def test_window_hashes_depend_on_the_window_only():
    words = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    for width in (1, 2, 5, 20, 31, 50):
        hashes = window_hashes(words, width)
        assert len(hashes) == 401 - width
        windows = [tuple(words[i : i + width]) for i in range(401 - width)]
        assert len(set(zip(windows, hashes.tolist(), strict=True))) == len(set(windows))
        assert len(set(hashes.tolist())) == len(set(windows))
    assert len(window_hashes(words[:4], 5)) == 0
