from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplytic.llm import near_duplicates as near
from shoplytic.llm.components import connected_components


def _shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _expected(rows):
    """Every pair compared; rows are (doc_id, text)."""
    sets = [_shingles(t) for _, t in rows]
    least = [i for i, _ in rows]
    changed = True
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return sorted(
        ((i, len(s), c, i == c or i is None) for (i, _), s, c in zip(rows, sets, least, strict=True)),
        key=str,
    )


def _edited(pick, words, edits):
    words = list(words)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"new{pick.random()}"
    return words


def _rows(seed):
    pick = random.Random(seed)
    texts = []
    for g in range(25):
        base = [f"g{g}w{pick.randrange(500)}" for _ in range(pick.randint(5, 200))]
        for _ in range(pick.randint(1, 5)):
            texts.append(" ".join(_edited(pick, base, pick.randint(0, 3))))
    hot = [f"h{k}" for k in range(120)]
    # A large group of near copies, some of them a chain away from the rest.
    texts += [" ".join(_edited(pick, hot, pick.randint(0, 4))) for _ in range(120)]
    texts += [t.upper() for t in texts[:10]] + texts[:10]
    pick.shuffle(texts)
    return list(enumerate(texts, 10))


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, documents, seed):
    rows = _rows(seed)
    docs = documents(rows).withColumn("words_key", F.lit(1)).withColumn("keys", F.lit(2))
    assert _got(near.near_duplicates(docs)) == _expected(rows)


def test_small_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_MEMBERS", 5)
    assert _got(near.near_duplicates(documents(_rows(3)))) == _expected(_rows(3))


def test_links_that_only_members_have(spark, documents):
    """Of a, b, c with the least in the middle of none: links that no star can see."""
    words = [f"w{i}" for i in range(220)]
    rows = [
        (i, " ".join(words[: 4 * i] + [f"x{i}y{k}" for k in range(28)] + words[4 * i + 28 :]))
        for i in range(48)
    ]
    assert _got(near.near_duplicates(documents(rows))) == _expected(rows)


def test_odd_rows(spark, documents, odd_texts):
    assert _got(near.near_duplicates(documents(odd_texts))) == _expected(odd_texts)
    assert near.near_duplicates(documents([])).collect() == []
    alone = near.near_duplicates(documents([(1, None)])).collect()
    assert [tuple(r) for r in alone] == [(1, 0, 1, True)]


def test_one_row_of_each_group_stays(spark, documents, odd_texts):
    rows = [*_rows(5), *[(i, t) for i, t in odd_texts if i is None or i < 10]]
    docs = documents(rows).withColumn("row", F.lit("mine"))
    kept = near.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = {(i, t) for i, t in rows if (i, True) in {(e[0], e[3]) for e in _expected(rows)}}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        expected, key=str
    )


def test_signature_estimates_similarity():
    circulant = near.Circulant(512, 16, 3)
    values = near.mixed(np.arange(3000, dtype=np.uint64))
    a, b = circulant.signature(values[:2000]), circulant.signature(values[500:2500])
    assert (a == b).mean() == pytest.approx(1500 / 2500, abs=0.09)
    # Coordinate k is the first permutation read k places further on.
    table = near.Circulant(1, 16, 3).rows[:, 0]
    places = near.mixed(values[:50] ^ np.uint64(3)) >> np.uint64(48)
    for k in (0, 1, 511):
        assert circulant.signature(values[:50])[k] == table[(places + np.uint64(k)) % 65536].min()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    links = [(pick.randrange(150), pick.randrange(150)) for _ in range(90)]
    links += [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 380)] + [(7, 7)]
    parent = {i: i for pair in links for i in pair}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, root(i)) for i in parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
