import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shop_data import rows
from shoplytic.operators.ranking import exact_median, global_ranks, in_sorted_slices, ntile


def _data(spark, n, values, groups, seed):
    rng = random.Random(seed)
    records = [
        (i, rng.choice(groups), float(rng.choice(values) if rng.random() < 0.8 else i))
        for i in range(n)
    ]
    return spark.createDataFrame(records, "id long, tier string, spent double").repartition(6)


@pytest.mark.parametrize(
    ("n", "values", "groups"),
    [
        (400, [7], ["a", "b"]),  # one value holds most rows and spans many slices
        (400, [1, 2, 3], ["a", "b", None]),
        (400, range(1000), ["a"]),
        (5, [1, 2], ["a", "b"]),
        (1, [3], ["a"]),
    ],
)
def test_global_ranks_equal_plain_windows(many_slices, n, values, groups):
    df = _data(many_slices, n, list(values), groups, seed=n)
    ranked = global_ranks(df, "spent", "id", within=["tier"])
    plain = df.select(
        "*",
        F.row_number().over(Window.orderBy(F.desc("spent"), "id")).alias("row_number"),
        F.rank().over(Window.partitionBy("tier").orderBy(F.desc("spent"))).alias("rank"),
    )
    got = sorted((r["id"], r["row_number"], r["rank"]) for r in rows(ranked))
    assert got == sorted((r["id"], r["row_number"], r["rank"]) for r in rows(plain))
    totals = {(r["rows_total"], r["value_total"]) for r in rows(ranked)}
    assert totals == {(n, df.agg(F.sum("spent")).first()[0])}


def test_slices_are_many(many_slices):
    df = _data(many_slices, 400, [7], ["a"], seed=1)
    assert in_sorted_slices(df, F.desc("spent"), F.asc("id")).select("_slice").distinct().count() > 3


def test_rank_without_groups(many_slices):
    df = _data(many_slices, 300, [1, 1, 2], ["a"], seed=5)
    ranked = global_ranks(df, "spent", "id")
    plain = df.select("id", F.rank().over(Window.orderBy(F.desc("spent"))).alias("rank"))
    assert sorted((r["id"], r["rank"]) for r in rows(ranked)) == sorted(
        (r["id"], r["rank"]) for r in rows(plain)
    )


def test_empty(spark):
    df = spark.createDataFrame([], "id long, tier string, spent double")
    assert rows(global_ranks(df, "spent", "id", within=["tier"])) == []
    assert rows(exact_median(df, "spent")) == [{"median": None}]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 11])
def test_ntile(spark, n):
    df = spark.range(1, n + 1)
    got = df.select(
        "id",
        ntile(F.col("id"), F.lit(n), 4).alias("mine"),
        F.ntile(4).over(Window.orderBy("id")).alias("plain"),
    )
    assert all(r["mine"] == r["plain"] for r in rows(got))


@pytest.mark.parametrize("n", [1, 2, 3, 100, 101])
def test_exact_median(many_slices, n):
    df = _data(many_slices, n, [4, 4, 9], ["a"], seed=n)
    assert exact_median(df, "spent").first()[0] == df.agg(F.median("spent")).first()[0]


def test_median_skips_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert exact_median(df, "v").first()[0] == 2.5
