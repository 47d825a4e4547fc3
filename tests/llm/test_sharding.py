"""Histogram sort against sorting all rows."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from shoplytic.llm import sharding

LOW = sharding.LOWEST


def _frame(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, size long")


def _sorted_shards(rows, shards):
    """Shard per row: i/shards of all bytes lie before the first key of shard i."""
    total = sum(r[2] for r in rows)
    keyed = sorted(((LOW if a is None else a, LOW if b is None else b), s) for a, b, s in rows)
    found, before, at = [], 0, 0
    while at < len(keyed):
        end = at
        while end < len(keyed) and keyed[end][0] == keyed[at][0]:
            end += 1
        shard = min(shards - 1, before * shards // total)
        found += [(*keyed[i][0], keyed[i][1], shard) for i in range(at, end)]
        before += sum(s for _, s in keyed[at:end])
        at = end
    return sorted(found)


def _cases():
    pick = random.Random(4)
    wide = [(pick.randint(-(2**63), 2**63 - 1), i, pick.randint(1, 500)) for i in range(400)]
    hot = [(77, i, 10) for i in range(300)] + wide[:150]
    return {
        "spread": wide,
        "hot key": hot,
        "neighbours": [(i // 3, i % 3, 1 + i % 7) for i in range(200)],
        "one giant": [(1, 1, 10**9), *wide[:50]],
        "nulls": [(None, 1, 5), (None, None, 6), (3, None, 7), *wide[:30]],
        "repeated rows": [(5, 5, 3)] * 40 + wide[:20],
        "single": [(1, 1, 1)],
    }


@pytest.mark.parametrize("name", list(_cases()))
@pytest.mark.parametrize("probes", [8, 4096])
def test_boundaries_are_exact(spark, name, probes):
    rows = _cases()[name]
    df = _frame(spark, rows)
    got = sharding.histogram_sort(
        df, F.col("a"), F.col("b"), F.col("size"), 7, probes=probes
    ).collect()
    assert sorted(
        (LOW if r["a"] is None else r["a"], LOW if r["b"] is None else r["b"], r["size"], r["shard"])
        for r in got
    ) == _sorted_shards(rows, 7)
    for shard in {r["shard"] for r in got}:
        part = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        keys = [(r["a"] or 0, r["b"] or 0) for r in part if r["a"] is not None]
        assert name == "nulls" or keys == sorted(keys)


def test_pieces_change_nothing(spark):
    df = _frame(spark, _cases()["spread"])
    args = (df, F.col("a"), F.col("b"), F.col("size"), 5)
    whole = sharding.histogram_sort(*args).collect()
    cut = sharding.histogram_sort(*args, piece_bytes=1500).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_tolerance_takes_a_near_boundary(spark):
    rows = _cases()["spread"]
    got = sharding.histogram_sort(
        _frame(spark, rows), F.col("a"), F.col("b"), F.col("size"), 4, tolerance=0.2, probes=64
    )
    total = sum(r[2] for r in rows)
    for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect():
        assert abs(r["s"] - total / 4) <= 0.25 * total / 4 + 500


def test_documents(spark, documents, odd_texts):
    copies = [(1000 + i, "the same text over and over") for i in range(200)]
    rows = [*odd_texts, *copies, *[(2000 + i, f"text {i} " * (i % 9)) for i in range(300)]]
    docs = documents(rows).withColumn("shard", F.lit("old")).withColumn("key", F.lit(1))
    got = sharding.document_shards(docs, 6)
    assert got.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    got = got.collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} <= set(range(6))
    sizes = [0] * 6
    for r in got:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 16
    largest = max(len((t or "").encode()) + 16 for _, t in rows)
    assert max(sizes) - min(sizes) <= 2 * largest
    # Equal texts are neighbours: their shards are consecutive.
    of_copies = sorted({r["shard"] for r in got if r["text"] == copies[0][1]})
    assert of_copies == list(range(of_copies[0], of_copies[-1] + 1))


def test_empty_and_no_python(spark, documents):
    assert sharding.document_shards(documents([]), 4).collect() == []
    plan = sharding.document_shards(documents([(1, "a"), (2, "b")]), 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and text.count("Exchange") == 1


def test_checksum_is_unsigned(spark, documents):
    assert documents([(1, "ab")]).select(F.crc32("text")).first()[0] == zlib.crc32(b"ab")


def test_a_plan_holds_the_bounds_once(spark):
    bounds = [(i, 7 * i) for i in range(-2000, 2001)]
    rows = [(i, i) for i in range(-2100, 2100, 7)]
    keyed = spark.createDataFrame([((a, b),) for a, b in rows], "key struct<a:long,b:long>")
    binned = sharding.with_bin(keyed, "key", bounds, "bin")
    assert binned.columns == ["key", "bin"]
    assert binned._jdf.queryExecution().executedPlan().toString().count("[1000,7000]") == 1
    found = {tuple(r["key"]): r["bin"] for r in binned.collect()}
    assert found == {key: sum(bound <= key for bound in bounds) for key in rows}
