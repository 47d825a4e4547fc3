"""What is written as a whole or not at all: appended loads and saved models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shop_data import AS_OF, rows
from shoplytic.operators import churn
from shoplytic.plans import churn as churn_model
from shoplytic.sources import tables

SCHEMA = "a int, b string"


def frame(spark, values):
    return spark.createDataFrame(values, "b string, a int, more int")


def read(spark, target):
    return sorted((r["a"], r["b"]) for r in tables.loaded(spark, target, SCHEMA).collect())


def test_a_load_run_twice_leaves_one_copy(spark, tmp_path):
    target = str(tmp_path / "t")
    first = frame(spark, [("x", 1, 0), ("y", 2, 0)])
    assert tables.append_once(first, target, ["a", "b"], "monday")
    assert not tables.append_once(first, target, ["a", "b"], "monday")
    assert tables.append_once(frame(spark, [("z", 3, 0)]), target, ["a", "b"], "tuesday")
    assert read(spark, target) == [(1, "x"), (2, "y"), (3, "z")]


def test_a_load_that_failed_is_replaced(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    tables.append_once(frame(spark, [("x", 1, 0)]), target, ["a", "b"], "monday")
    with monkeypatch.context() as patch:
        patch.setattr(
            tables.Ledger, "add", lambda *given: (_ for _ in ()).throw(RuntimeError("lost"))
        )
        with pytest.raises(RuntimeError):
            half = frame(spark, [("half", 8, 0)])
            tables.append_once(half, target, ["a", "b"], "tuesday")
    assert read(spark, target) == [(1, "x")]
    tables.append_once(frame(spark, [("y", 2, 0)]), target, ["a", "b"], "tuesday")
    assert read(spark, target) == [(1, "x"), (2, "y")]


def test_empty_loads_and_an_empty_table(spark, tmp_path):
    target = str(tmp_path / "t")
    assert read(spark, target) == []
    assert tables.append_once(frame(spark, []), target, ["a", "b"], "monday")
    assert read(spark, target) == []
    assert tables.append_once(frame(spark, [(None, None, 0)]), target, ["a", "b"], "tuesday")
    assert read(spark, target) == [(None, None)]


@pytest.fixture(scope="module")
def trained(spark, small):
    features = churn.churn_features(small, AS_OF).withColumn(
        "is_churned", (F.col("customer_id") % 2).cast("int")
    )
    features = features.crossJoin(spark.range(6)).withColumn(
        "customer_id", F.col("customer_id") + 100 * F.col("id")
    ).drop("id")
    return features, churn_model.train_churn(features, trees=3)


def test_a_reader_gets_a_whole_model_during_a_save(spark, trained, tmp_path, monkeypatch):
    features, (model, metrics) = trained
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        churn_model.load_model(path)
    first = churn_model.save_model(model, path, {r["metric"]: r["value"] for r in rows(metrics)})
    seen = []
    add = churn_model.Ledger.add

    def watched(ledger, *values):
        # The second version's files are there, its manifest is not: readers get the first.
        seen.append(churn_model.saved_models(path).first()["folder"])
        expected = rows(churn_model.score_churn(model, features))
        assert rows(churn_model.score_churn(churn_model.load_model(path), features)) == expected
        add(ledger, *values)

    with monkeypatch.context() as patch:
        patch.setattr(churn_model.Ledger, "add", watched)
        second = churn_model.save_model(model, path)
    assert seen == [first]
    newest, oldest = churn_model.saved_models(path).collect()
    assert (newest["folder"], oldest["folder"]) == (second, first)
    assert newest["tiers"] == sorted(newest["tiers"]) and "test_accuracy" in oldest["details"]
    expected = rows(churn_model.score_churn(model, features))
    for folder in (None, first):
        again = churn_model.load_model(path, folder)
        assert rows(churn_model.score_churn(again, features)) == expected


def test_the_scaling_is_saved_with_the_model(trained):
    features, (model, _) = trained
    scaled = model.transform(churn.churn_ratios(features))
    for column in ("total_spent", "days_since_registration"):
        found = scaled.agg(F.avg(f"scaled_{column}"), F.stddev_pop(f"scaled_{column}")).first()
        assert found[0] == pytest.approx(0, abs=1e-9)
        assert found[1] == pytest.approx(1) or found[1] == 0
