from __future__ import annotations

import math
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shoplytic.operators import scaling, selection


def decimals(spark, values):
    frame = spark.createDataFrame([(None if v is None else str(v),) for v in values], "v string")
    return frame.select(F.col("v").cast("decimal(30,4)").alias("v")).repartition(5)


def spread(count):
    """From very small to very large, with a value that a third of the rows share."""
    pick = random.Random(count)
    return [
        pick.choice([Decimal(7), Decimal(pick.randrange(-50, 50)),
                     Decimal(pick.randrange(10**18)).scaleb(-pick.randrange(4))])
        for _ in range(count)
    ]


@pytest.mark.parametrize("cells", [2, 2048])
@pytest.mark.parametrize("count", [1, 2, 3, 50, 400])
def test_every_position(spark, count, cells):
    values = spread(count)
    frame = decimals(spark, [*values, None])
    order = sorted(values)
    asked = sorted({1, 2, count // 3 + 1, count // 2 + 1, count})
    got = selection.order_statistics(frame, "v", [*asked, 0, count + 1], cells)
    expected = [order[p - 1] if p <= count else None for p in asked]
    assert got == [*expected, None, None]


def test_doubles_and_whole_numbers(spark):
    pick = random.Random(1)
    values = [pick.choice([-1, 1]) * math.exp(pick.uniform(-600, 600)) for _ in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert selection.median(frame, "v") == statistics.median(values)
    longs = [2**62 + i for i in range(101)]
    frame = spark.createDataFrame([(v,) for v in longs], "v long")
    assert selection.order_statistics(frame, "v", [1, 51, 101]) == [longs[0], longs[50], longs[100]]


def test_quantile_limits(spark):
    frame = decimals(spark, [1, 1, 1, 2, 3, 4, 5, 6, None])
    got = [(r.part, float(r.limit), r.rows_up_to) for r in
           selection.quantile_limits(frame, "v").collect()]
    assert got == [(1, 1.0, 3), (2, 2.0, 4), (3, 4.0, 6), (4, 6.0, 8)]
    empty = selection.quantile_limits(decimals(spark, [None]), "v").collect()
    assert [(r.limit, r.rows_up_to) for r in empty] == [(None, 0)] * 4


def test_no_sort_and_no_range_exchange(spark):
    values = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    plans = []
    original = type(values).collect

    def collect(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return original(frame)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(values), "collect", collect)
        assert selection.median(values, "v") == 499.5
    assert plans and not any("rangepartitioning" in p or "Sort " in p for p in plans)


def test_moments_merge(spark):
    pick = random.Random(4)
    rows = [(i % 5, pick.gauss(1e6, 3), pick.choice([None, 1.0, 9.0]), 4) for i in range(500)]
    frame = spark.createDataFrame(rows, "part int, a double, b double, c int")
    columns = ["a", "b", "c"]
    whole = {r.column_name: r for r in scaling.moments(frame, columns).collect()}
    parts = scaling.moments(frame, columns, ["part"]).drop("part")
    joined = {r.column_name: r for r in scaling.merged(parts).collect()}
    for c, i in zip(columns, (1, 2, 3), strict=True):
        values = [r[i] for r in rows if r[i] is not None]
        for found in (whole[c], joined[c]):
            assert found.n == len(values)
            assert found.mean == pytest.approx(statistics.fmean(values), rel=1e-12)
            assert math.sqrt(found.squares / found.n) == pytest.approx(
                statistics.pstdev(values), rel=1e-9
            )


def test_scaled_columns(spark):
    frame = spark.createDataFrame([(1.0, 5), (3.0, 5), (None, 5)], "a double, b int")
    fitted = scaling.fit_scaling(frame, ["a", "b"])
    assert fitted == scaling.Scaling({"a": 2.0, "b": 5.0}, {"a": 1.0, "b": 0.0})
    assert [tuple(r) for r in fitted.apply(frame).collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    frame.createOrReplaceTempView("to_scale")
    by_sql = spark.sql(f"SELECT {fitted.sql('s_')} FROM to_scale").collect()
    assert [tuple(r) for r in by_sql] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    nothing = scaling.fit_scaling(frame.limit(0), ["a"])
    assert nothing == scaling.Scaling({"a": 0.0}, {"a": 0.0})
