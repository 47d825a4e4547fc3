from __future__ import annotations

import numpy as np
import pytest

from shoplytic.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def vectors(spark, rows):
    """Rows of (vec_id, vector), with two columns named like those of the result."""
    return spark.createDataFrame([(i, v, "other", 9) for i, v in rows], SCHEMA)


def brute(rows, most=32):
    """Everything from the whole matrix: exact sums, and the eigenvectors of its covariance."""
    x = np.floor(np.array(rows, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    rest = exact / n
    values, turned = np.linalg.eigh(rest.T @ rest / n)
    order = np.argsort(-values)[:most]
    return (exact * exact).sum(axis=1), rest, values[order], turned[:, order], values.sum()


def table(result, count):
    found = {(r.vec_id, r.component): r for r in result.collect()}
    ids = sorted({i for i, _ in found})
    return found, ids, np.array([[found[i, c].whitened for c in range(1, count + 1)] for i in ids])


def test_equals_brute_force(spark):
    random = np.random.default_rng(3)
    mixing = random.standard_normal((40, 40)) * np.geomspace(1, 0.05, 40)
    data = (random.standard_normal((700, 40)) @ mixing).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    result = whitening.whiten(vectors(spark, rows).repartition(5))
    assert result.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    assert result.count() == 700 * 32
    deviation, rest, values, turned, trace = brute(data)
    found, ids, y = table(result, 32)
    expected = rest @ turned / np.sqrt(values)
    signs = np.sign((y * expected).sum(axis=0))
    assert np.abs(y * signs - expected).max() < 1e-9
    assert [found[i, 1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in found.values()} == {700}
    shares = np.array([found[0, c].explained for c in range(1, 33)])
    assert np.abs(shares / (values / trace) - 1).max() < 1e-12
    assert {r.identity_error for r in found.values()}.pop() < 1e-9


def test_equal_variances_are_all_found(spark):
    # Every direction varies alike: the recurrence breaks down at once and starts anew.
    rows = [
        (2 * axis + side, [(1.0 if side else -1.0) if j == axis else 0.0 for j in range(6)])
        for axis in range(6)
        for side in range(2)
    ]
    _, _, y = table(whitening.whiten(vectors(spark, rows)), 6)
    assert np.abs(y.T @ y / len(rows) - np.eye(6)).max() < 1e-9


def test_directions_without_variation(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    found, _, _ = table(whitening.whiten(vectors(spark, rows)), 3)
    assert found[4, 1].whitened is not None and found[4, 1].explained == pytest.approx(1.0)
    assert found[4, 2].whitened is None and found[4, 3].whitened is None
    assert found[4, 3].explained == 0.0
    assert found[4, 1].identity_error < 1e-9


def test_rows_that_do_not_count(spark):
    rows = [
        (1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]),
        (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
        (7, [float("inf"), 0.0]), (8, [1.0]), (9, [1e30, 0.0]),
    ]
    result = whitening.whiten(vectors(spark, rows))
    assert sorted((r.vec_id or 0) for r in result.collect()) == [0, 0, 1, 1, 2, 2, 2, 2]
    assert {r.n for r in result.collect()} == {4}
    deviation, *_ = brute([[1.0, 2.0], [3.0, -1.0], [3.0, -1.0], [0.5, 0.25]])
    assert {r.deviation for r in result.collect()} == set(deviation.tolist())


def test_one_row_and_no_rows(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in one] == [
        (1, 0, None, 0.0), (2, 0, None, 0.0)
    ]
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float((1 << 30) * i), float(i % 2)]) for i in range(6)]
    result = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    xs = [[(1 << 36) * i + 1_000_000, 64 * (i % 2) + 1_000_000] for i in range(6)]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    exact = [sum((6 * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in xs]
    assert result == {i: (e if e < 2**63 else None) for i, e in enumerate(exact)}
