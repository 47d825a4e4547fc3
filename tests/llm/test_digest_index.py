from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplytic.llm.digest_index import DigestIndex, text_digests


def _index(spark, tmp_path):
    return DigestIndex(spark, f"{tmp_path}/index-{uuid.uuid4().hex}", buckets=4)


def test_assignment(spark, documents, odd_texts, tmp_path):
    rows = [*odd_texts, *[(100 + i, "hot") for i in range(50)], (20, "one")]
    digests = text_digests(documents(rows).withColumn("digest", F.lit(1)))
    index = _index(spark, tmp_path)
    index.append(digests)
    got = [tuple(r) for r in index.assign(digests).collect()]
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        own = [r for r in got if r[4] == hashlib.sha256(text.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert Counter(r[0] for r in own) == Counter(ids)
        assert all(r[1] == keep and r[2] == len(ids) for r in own)
        assert [r[0] for r in own if r[3]] == [keep]


def test_first_arrival_stays_and_repeats_add_nothing(spark, documents, tmp_path):
    index = _index(spark, tmp_path)
    first = text_digests(documents([(1, "a"), (2, "b"), (9, "a")]))
    second = text_digests(documents([(5, "b"), (6, "c"), (7, "c")]))
    index.append(first)
    index.append(second)
    index.append(second)
    # Another session opens the same folder.
    spark.sql(f"DROP TABLE {index.table}")
    again = DigestIndex(spark, index.folder, buckets=4)
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [2, 7, 9]
    assert again.unseen(second).count() == 0


def test_anti_join_does_not_shuffle_the_index(spark, documents, tmp_path):
    index = _index(spark, tmp_path)
    index.append(text_digests(documents([(i, str(i)) for i in range(100)])))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = index.unseen(text_digests(documents([(1, "x")])))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert "SortMergeJoin" in text and text.count("Exchange") == 1 and "Bucketed: true" in text


def test_empty(spark, documents, tmp_path):
    index = _index(spark, tmp_path)
    digests = text_digests(documents([]))
    index.append(digests)
    assert index.assign(digests).collect() == []


def test_another_bucket_count_is_refused(spark, documents, tmp_path):
    folder = f"{tmp_path}/index-{uuid.uuid4().hex}"
    index = DigestIndex(spark, folder, buckets=4)
    index.append(text_digests(documents([(1, "a"), (2, "b")])))
    # The catalog forgets the table, as a later session does.
    spark.sql(f"DROP TABLE {index.table}")
    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, folder, buckets=8)
    again = DigestIndex(spark, folder, buckets=4)
    again.append(text_digests(documents([(5, "a"), (6, "c")])))
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [1, 2, 6]
