from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shoplytic.llm import merkle

DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string, tree int"


def frame(spark, rows):
    """Documents with a column of a name that the operator uses too."""
    return spark.createDataFrame([(*r, 7) for r in rows], DOCUMENT)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    fields = [None if v is None else str(v) for v in row]
    return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def changed(row):
    if row[0] is None or row[4] is None or zlib.crc32(str(row[0]).encode()) % 2:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def tower(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def climb(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [
        sorted(
            (r for r in rows if r[1] == s),
            key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)),
        )
        for s in sources
    ]
    towers = [tower([leaf(r) for r in g]) for g in groups]
    top = tower([t[-1][0] for t in towers])
    root, found = top[-1][0], []
    for number, (group, levels) in enumerate(zip(groups, towers, strict=True)):
        for at, row in enumerate(group):
            path = [*climb(levels, at), *climb(top, number)]
            value = leaf(changed(row))
            for left, right in path:
                value = sha("".join(left) + value + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in path))
            found.append(
                (row[0], leaf(row), levels[-1][0], root, proof, value, value == root)
            )
    return sorted(found, key=str)


def got(spark, rows, parts=4):
    result = merkle.proofs(merkle.build(frame(spark, rows).repartition(parts)))
    assert result.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    ]
    return sorted((tuple(r) for r in result.collect()), key=str)


def made(ids, source="s", seed=1):
    chosen = random.Random(seed)
    return [
        (i, source, "en", 5, f"text {i}" + chosen.choice(["", "\n", " a\nb\n"])) for i in ids
    ]


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28, 729, 730, 2200])
def test_one_source_of_any_size(spark, count):
    rows = made(range(5, 5 + 3 * count, 3))
    assert got(spark, rows) == brute(rows)


def test_many_sources(spark):
    chosen = random.Random(4)
    names = [None, "", "a", "é", "z", "Z", *[f"site{i}" for i in range(40)]]
    rows = [r for n in names for r in made(chosen.sample(range(10_000), chosen.randrange(1, 40)), n)]
    assert got(spark, rows) == brute(rows)


def test_ids_spread_over_all_longs(spark):
    chosen = random.Random(5)
    ids = {chosen.randrange(-(2**63), 2**63) for _ in range(300)}
    ids |= {-(2**63), 2**63 - 1, 0, -1, 1, 63, 64, -64, -65, 2**32, 4095, 4096}
    rows = made(sorted(ids), "a") + made(sorted(ids)[::7], "b")
    assert got(spark, rows) == brute(rows)


def test_nulls_and_repeats(spark):
    rows = made(range(100)) + [
        (None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id"), (None, "s", None, None, None),
        (None, None, None, None, None), (None, None, None, None, None), (3, "s", "en", 5, "other"),
        (3, "s", None, 5, "other"), (3, "s", "en", None, "other\n"), (4, "s", "en", 1, ""),
        (200, None, "en", 1, "\n"), (200, None, "en", 1, "\n"), (200, None, "en", 1, "-"),
        (63, "s", "en", 5, "last bit\n"), (64, "s", "en", 5, "first bit\n"),
        (7, "long", "en", 2, "w\n" * 400_000),
    ]
    assert got(spark, rows) == brute(rows)


def test_many_rows_of_one_id_and_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES_PER_TASK", 50)
    rows = made(range(50)) + [(17, "s", "en", 1, f"v{i}") for i in range(300)]
    rows += [(30, "s", "en", 1, "same\n")] * 170
    assert got(spark, rows) == brute(rows)


def test_no_documents(spark):
    manifest = merkle.build(frame(spark, []))
    assert manifest.root is None
    assert merkle.proofs(manifest).collect() == []


def test_positions_come_without_sorting_documents(spark):
    ids = spark.range(20_000).select(
        F.struct(F.lit("s").alias("source")).alias("group"),
        (F.col("id") * 37).alias("key"),
        F.lit(1).cast("long").alias("rows"),
    )
    found, repeated = merkle.ranked(ids)
    assert repeated is None
    assert found.filter("before != key div 37").count() == 0
