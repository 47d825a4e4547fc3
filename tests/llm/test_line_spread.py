from __future__ import annotations

import random

from pyspark.sql import functions as F

from shoplytic.llm import line_spread


def _rows():
    pick = random.Random(3)
    rows = []
    for i in range(400):
        lines = [f"own {i} {k}" for k in range(3)]
        # Line n is on about n of 30 sites, so some are near any threshold.
        site = i % 30
        lines += [f"shared {n}" for n in range(30) if site < n and pick.random() < 0.9]
        pick.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{site}" if site else None))
    return [*rows, (900, None, "s1"), (901, "", "s2"), (902, "  \n\n shared 20", "s3"), (1, "x", "s")]


def _boilerplate(rows, least):
    sites = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip():
                sites.setdefault(line, set()).add(source)
    return {line for line, found in sites.items() if len(found) >= least}


def _cut(rows, least):
    out = _boilerplate(rows, least)
    result = []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [line for line in lines if line not in out]
        result.append(
            (i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept))
        )
    return result


def test_against_exact_counts(spark, documents):
    docs = documents(_rows()).withColumn("line_key", F.lit(1)).withColumn("n_lines", F.lit("x"))
    for least in (2, 10, 20):
        cut = line_spread.without_boilerplate(docs, line_spread.boilerplate_lines(docs, least))
        got = [tuple(r) for r in cut.select("doc_id", "n_lines", "n_removed", "kept_text").collect()]
        assert sorted(got, key=str) == sorted(_cut(_rows(), least), key=str)


def test_a_coarse_sketch_is_corrected_near_the_threshold(spark, documents):
    docs = documents(_rows())
    exact = len(_boilerplate(_rows(), 15))
    assert line_spread.boilerplate_lines(docs, 15, sketch_bits=4, near=0.9).count() == exact


def test_empty(spark, documents):
    docs = documents([])
    cut = line_spread.without_boilerplate(docs, line_spread.boilerplate_lines(docs))
    assert cut.collect() == []
