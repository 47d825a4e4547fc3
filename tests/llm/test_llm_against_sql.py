"""Queries with SQL next to it, and all of them on the smallest tables."""

from __future__ import annotations

import pytest

from shoplytic.llm.oracles import llm_oracle_sql
from shoplytic.llm.queries import llm_queries
from verification import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    made = compare.database(FOLDER)
    yield made
    made.close()


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_matches_sql(spark, connection, name):
    frame = llm_queries()[name](spark, FOLDER)
    result = connection.execute(llm_oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = compare._sorted_rows(columns, result.fetchall())
    assert compare._sorted_rows(frame.columns, frame.collect()) == expected


# Those of leaks, pages, vectors and all stages have other rows.
OTHER = {"op10_pigeonhole_leaks", "op12_boundary_chain", "op13_lanczos_whitening", "pipeline"}


@pytest.mark.parametrize("name", sorted(set(llm_queries()) - OTHER))
def test_one_row_per_document(spark, name):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = [r["doc_id"] for r in llm_queries()[name](spark, FOLDER).select("doc_id").collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())
