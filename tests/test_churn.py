import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shop_data import AS_OF, rows, shop
from shoplytic.operators import churn
from shoplytic.plans import churn as model_plan


def by_customer(df):
    return {r["customer_id"]: r for r in rows(df)}


def test_tenure_of_30_days_is_enough(small):
    # Customer 4 has 30 days, customer 5 has 29.
    assert set(by_customer(churn.churn_features(small, AS_OF))) == {1, 2, 3, 4}


def test_line_grain_counts_an_order_once_per_line(small):
    line = by_customer(churn.churn_features(small, AS_OF))
    order = by_customer(churn.churn_features(small, AS_OF, grain="order"))
    assert line[1]["total_orders"] == 3 and order[1]["total_orders"] == 2
    assert line[1]["total_spent"] == Decimal("250.00")  # 100 + 100 + 50
    assert line[1]["avg_order_value"] == pytest.approx(250 / 3)
    assert order[1]["avg_order_value"] == 75.0
    assert line[2]["discount_orders"] == 2 and order[2]["discount_orders"] == 1
    assert line[1]["unique_products"] == order[1]["unique_products"] == 2
    assert line[1]["payment_methods_used"] == 2


def test_order_without_lines_counts_once(spark):
    t = shop(
        spark,
        customers=[{"customer_id": 1, "customer_tier": "Gold", "registration_date": "2024-01-01"}],
        orders=[{"order_id": 1, "customer_id": 1, "order_date": "2024-12-01",
                 "order_status": "shipped", "total_amount": 7, "discount_amount": 0}],
    )
    got = by_customer(churn.churn_features(t, AS_OF))[1]
    assert (got["total_orders"], got["unique_products"]) == (1, 0)


def test_windows_include_their_first_day(spark):
    days_ago = {1: 90, 2: 91, 3: 120, 4: 121}
    t = shop(
        spark,
        customers=[{"customer_id": i, "customer_tier": "Gold", "registration_date": "2020-01-01"}
                   for i in days_ago],
        orders=[{"order_id": i, "customer_id": i, "order_status": "shipped", "total_amount": 1,
                 "order_date": str(AS_OF - dt.timedelta(days=n))} for i, n in days_ago.items()],
    )
    got = by_customer(churn.churn_features(t, AS_OF, grain="order"))
    assert [got[i]["orders_last_90_days"] for i in days_ago] == [1, 0, 0, 0]
    assert [got[i]["is_churned"] for i in days_ago] == [0, 0, 0, 1]


def test_customers_without_valid_orders(small):
    got = by_customer(churn.churn_features(small, AS_OF))
    for i in (3, 4):
        assert got[i]["is_churned"] == 1 and got[i]["total_orders"] == 0
        assert got[i]["avg_order_value"] == 0 and got[i]["avg_discount_used"] == 0
    assert got[4]["days_since_last_order"] == got[4]["days_since_registration"] == 30


def test_unknown_grain(small):
    with pytest.raises(ValueError):
        churn.churn_features(small, AS_OF, grain="week")


def test_horizon_label_and_features_do_not_overlap(small):
    got = by_customer(churn.churn_features_at_horizon(small, AS_OF, 60, grain="order"))
    # Known by 2024-11-02: one order of customer 1, who came back on 2024-12-31.
    assert got[1]["total_orders"] == 1 and got[1]["is_churned"] == 0
    assert got[2]["is_churned"] == 1
    assert set(got) == {1, 2, 3}


def test_ratios_and_codes(small):
    got = by_customer(churn.churn_model_inputs(churn.churn_features(small, AS_OF)))
    assert [got[i]["customer_tier_encoded"] for i in (3, 1, 4)] == [0.0, 1.0, 2.0]
    assert got[1]["order_frequency"] == pytest.approx(3 / (366 / 30))
    assert got[1]["recent_activity_ratio"] == 1.0  # the older order is exactly 90 days old
    assert got[3]["spending_per_day"] == 0


def test_missing_inputs_become_zero(small):
    features = churn.churn_features(small, AS_OF).drop("unique_products")
    assert {r["unique_products"] for r in rows(churn.churn_ratios(features))} == {0.0}


def test_at_risk_band_is_open(spark):
    records = [(90, 3), (91, 3), (91, 2), (364, 3), (365, 3)]
    df = spark.createDataFrame(records, "days_since_last_order int, total_orders long")
    assert churn.retention_alert_count(df).first()[0] == 2


def test_summaries(small):
    features = churn.churn_features(small, AS_OF, grain="order")
    got = rows(churn.churn_dataset_summary(features))[0]
    assert got == {"customers": 4, "churn_rate": 0.5, "avg_total_spent": 75.0,
                   "avg_total_orders": 0.75}
    assert rows(churn.clv_by_tier(features))[0]["customer_tier"] == "Gold"


def test_split_is_exact_and_repeats(many_slices):
    df = many_slices.range(1000).select(
        "id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label")
    )
    first = model_plan.stratified_split(df, "label", "id")
    sizes = {r["label"]: r["n"] for r in rows(
        first.filter("is_test").groupBy("label").agg(F.count("*").alias("n")))}
    assert sizes == {0: 180, 1: 20}
    assert first.count() == 1000
    again = model_plan.stratified_split(df.repartition(3), "label", "id")
    picked = [sorted(r["id"] for r in rows(s.filter("is_test"))) for s in (first, again)]
    assert picked[0] == picked[1]
    other = model_plan.stratified_split(df, "label", "id", seed=7)
    assert sorted(r["id"] for r in rows(other.filter("is_test"))) != picked[0]


def test_split_of_a_tiny_class(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(100)], "id long, label int")
    got = rows(model_plan.stratified_split(df, "label", "id").filter("is_test AND label = 1"))
    assert len(got) == 1


@pytest.fixture(scope="module")
def trained(spark):
    """A shop whose silent customers are clearly silent."""
    records = [
        (i, ("Gold", "Silver")[i % 2], 400, 5 + i % 7, Decimal(100 + i), 20.0 + i,
         (10 if i % 3 else 200), i % 3, Decimal(i), 3, 2, 1, 1.0, 0 if i % 3 else 1)
        for i in range(240)
    ]
    features = spark.createDataFrame(
        records,
        "customer_id long, customer_tier string, days_since_registration int, total_orders long, "
        "total_spent decimal(18,2), avg_order_value double, days_since_last_order int, "
        "orders_last_90_days long, spent_last_90_days decimal(18,2), unique_products long, "
        "payment_methods_used long, discount_orders long, avg_discount_used double, "
        "is_churned int",
    )
    model, metrics = model_plan.train_churn(features, trees=5)
    return features, model, {r["metric"]: r["value"] for r in rows(metrics)}


def test_training(trained):
    _, model, metrics = trained
    assert set(metrics) == {"train_accuracy", "test_accuracy", "auc_score"}
    assert metrics["auc_score"] == pytest.approx(1.0)
    importance = rows(model_plan.feature_importance(model))
    assert len(importance) == 15
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)
    values = [r["importance"] for r in importance]
    assert values == sorted(values, reverse=True)


def test_scoring_and_saving(trained, tmp_path):
    features, model, _ = trained
    scored = by_customer(model_plan.score_churn(model, features))
    assert len(scored) == 160  # customers who have not churned
    few = model_plan.score_churn(model, features, [1, 2, 3])
    assert set(by_customer(few)) == {1, 2}
    assert len(by_customer(model_plan.score_churn(model, features, []))) == 160
    path = str(tmp_path / "model")
    model_plan.save_model(model, path)
    again = by_customer(model_plan.score_churn(model_plan.load_model(path), features))
    assert again == scored
    new_tier = features.withColumn("customer_tier", F.lit("Unseen"))
    assert model_plan.score_churn(model, new_tier).count() == 160


def test_forest_keeps_reached_nodes_and_grows_the_same_trees(trained):
    features, _, _ = trained
    split = model_plan.churn_ratios(features).withColumn("class_weight", F.lit(1.0)).coalesce(1)
    tiers = model_plan.tier_codes().fit(split)
    scaling = model_plan.fit_scaling(tiers.transform(split), model_plan.MODEL_COLUMNS)
    plan = model_plan.churn_pipeline(tiers, scaling, trees=3)
    forest = plan.getStages()[-1]
    assert forest.getCacheNodeIds()
    kept = plan.fit(split).stages[-1].toDebugString.split("\n", 1)[1]
    forest.setCacheNodeIds(False)
    assert plan.fit(split).stages[-1].toDebugString.split("\n", 1)[1] == kept


def test_untrained(small):
    with pytest.raises(ValueError):
        model_plan.score_churn(None, small.customers)
    with pytest.raises(ValueError):
        model_plan.save_model(None, "nowhere")


def _predictions(spark, probabilities):
    from shoplytic.functions.labels import risk_level

    df = spark.createDataFrame(
        [(i, "Gold", Decimal(i), p) for i, p in enumerate(probabilities)],
        "customer_id long, customer_tier string, total_spent decimal(18,2), "
        "churn_probability double",
    )
    return df.withColumn("risk_level", risk_level(F.col("churn_probability")))


def test_risk_summary_keeps_empty_levels(spark):
    got = rows(model_plan.risk_summary(_predictions(spark, [0.0, 0.2, 0.3, 0.9])))
    assert [(r["risk_level"], r["customers"]) for r in got] == [
        ("Low Risk", 2), ("High Risk", 1), ("Medium Risk", 0)
    ]
    assert {r["total_analyzed"] for r in got} == {4}
    assert got[0]["avg_churn_probability"] == pytest.approx(0.35)
    none = rows(model_plan.risk_summary(_predictions(spark, [0.5]).filter("false")))
    assert [r["customers"] for r in none] == [0, 0, 0]


def test_risk_top_customers(spark):
    predictions = _predictions(spark, [0.5] * 7 + [0.9, 0.8, 0.1])
    got = rows(model_plan.risk_top_customers(predictions))
    assert sorted((r["risk_level"], r["customer_id"]) for r in got) == [
        ("High Risk", 7), ("High Risk", 8), *[("Medium Risk", i) for i in range(5)]
    ]
    assert model_plan.risk_points(predictions).count() == 10
