from __future__ import annotations

from pyspark.sql import functions as F

from verification import model_parts


def test_order_is_checked_without_gathering_rows(many_slices, monkeypatch):
    rows = many_slices.range(30_000).select(
        F.col("id").alias("customer_id"), (F.col("id") % 7 / 7.0).alias("p")
    )
    columns = (("p", -1), ("customer_id", 1))
    gathered = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: gathered.append(collect(df)) or gathered[-1])
    assert model_parts._in_order(rows.orderBy(F.desc("p"), "customer_id"), *columns)
    assert not model_parts._in_order(rows.orderBy("p", "customer_id"), *columns)
    assert not model_parts._in_order(rows.orderBy(F.desc("p"), F.desc("customer_id")), *columns)
    assert model_parts._in_order(rows.filter("false"), *columns)
    assert sum(len(found) for found in gathered) < 100
    # Batches in order, but the tasks are not.
    swapped = rows.select("customer_id", "p").repartition(4, "p").sortWithinPartitions(
        F.desc("p"), "customer_id"
    )
    assert not model_parts._in_order(swapped, *columns)
    names = many_slices.createDataFrame([(0.5, "a"), (0.5, "b"), (0.1, "a")], "i double, f string")
    assert model_parts._in_order(names.coalesce(1), ("i", -1), ("f", 0))
