from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from shoplytic.llm import mixing


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation(size):
    index = np.arange(size)
    full = np.full(size, size)
    one = mixing.permuted(index, full, np.full(size, 5))
    other = mixing.permuted(index, full, np.full(size, 6))
    assert sorted(one) == sorted(other) == list(range(size))
    assert size < 50 or (one != other).mean() > 0.9
    assert size < 50 or abs(np.corrcoef(index, one)[0, 1]) < 0.2


def _filled(sizes, weights, share, most):
    """Targets by sharing out the excess again and again."""
    total, targets, capped = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in free)
        targets = [
            most * s if i in capped else rest * weights[i] / weight for i, s in enumerate(sizes)
        ]
        over = {i for i in free if targets[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return targets
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    pick = random.Random(seed)
    names = [f"s{i:02d}" for i in range(pick.randint(1, 12))] + [None]
    sizes = [pick.choice([0, 1, 10, 500, 10_000]) * pick.randint(1, 9) for _ in names]
    frame = spark.createDataFrame(
        list(zip(names, sizes, strict=True)), "source string, source_size long"
    )
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
    expected = _filled(sizes, weights, mixing.SHARE, mixing.MOST)
    for name, target in zip(names, expected, strict=True):
        assert got[name] == pytest.approx(target, abs=1e-6)


def _rows(seed=1):
    pick = random.Random(seed)
    rows = []
    for i in range(600):
        source = pick.choice(["hot"] * 5 + ["b", "c", None])
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(pick.randint(0, 200))), source))
    return [*rows, (600, None, "b"), (601, "", "hot"), (7, "same id", "c"), (7, "same id", "c")]


def test_mix_comes_to_the_targets(spark, documents):
    docs = documents(_rows())
    placed = mixing.positions(docs, 16).cache()
    got = mixing.words_taken(placed, mixing.mix(placed, 16, 8)).collect()
    assert len(got) == len(_rows())
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums = by_source.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        sums[2] += r["taken"]
        sums[3] += r["size"]
    for target, source_size, taken, size in by_source.values():
        assert source_size == size and abs(taken - target) <= 24
    again = mixing.positions(docs.repartition(7), 16)
    again = mixing.words_taken(again, mixing.mix(again, 16, 8)).collect()
    key = lambda r: (r["doc_id"], r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_slots_hold_whole_passes(spark, documents):
    placed = mixing.positions(documents(_rows()), 16).cache()
    drawn = mixing.slots(placed, 8).collect()
    figures = {r["source_key"]: (r["blocks"], r["quota"]) for r in placed.collect()}
    for key, (blocks, quota) in figures.items():
        own = [r for r in drawn if r["source_key"] == key]
        assert sorted(r["draw"] for r in own) == list(range(quota))
        times = Counter(r["block"] for r in own)
        assert all(quota // max(blocks, 1) <= times[b] <= -(-quota // blocks) for b in range(blocks))
    assert len({r["shard"] for r in drawn}) == 8


def test_mixed_documents(spark, documents):
    docs = documents(_rows())
    placed = mixing.positions(docs, 16).cache()
    taken = Counter()
    for r in mixing.words_taken(placed, mixing.mix(placed, 16, 8)).collect():
        taken[(r["doc_id"], r["source"])] += r["taken"]
    rows = mixing.mixed_documents(docs, 16, 8)
    assert rows.columns == docs.columns
    texts = {}
    for i, text, source in _rows():
        texts.setdefault((i, source), set()).update((text or "").split())
    got = Counter()
    for r in rows.collect():
        words = r["text"].split()
        assert set(words) <= texts[(r["doc_id"], r["source"])] and r["n_chars"] == len(r["text"])
        got[(r["doc_id"], r["source"])] += len(words)
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_empty_and_wordless(spark, documents):
    for rows in ([], [(1, None, None), (2, " ", "a")]):
        placed = mixing.positions(documents(rows))
        got = mixing.words_taken(placed, mixing.mix(placed)).collect()
        assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * len(rows)
        assert mixing.mixed_documents(documents(rows)).collect() == []
