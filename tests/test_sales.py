import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shop_data import day, rows, shop
from shoplytic.operators import sales
from shoplytic.plans import forecast

START = day("2024-01-01")


def _shop(spark, days, skip=()):
    orders = []
    for n in range(days):
        if n in skip:
            continue
        for k in range(2):
            orders.append(
                {"order_id": len(orders), "customer_id": k % 2,
                 "order_date": str(START + dt.timedelta(days=n)), "order_status": "delivered",
                 "payment_method": ("PayPal", "iDEAL")[k], "total_amount": 100 + n + k}
            )
    return shop(spark, orders=orders)


def test_daily_sales(spark):
    got = rows(sales.daily_sales(_shop(spark, 3, skip={1})))
    assert [r["sales_date"] for r in got] == [START, day("2024-01-03")]
    assert got[0]["order_count"] == 2 and got[0]["unique_customers"] == 2
    assert got[0]["avg_order_value"] == 100.5
    assert [r["day_of_week"] for r in got] == [1, 3]  # Monday, Wednesday


def test_fewer_than_31_days_give_no_features(spark):
    assert sales.sales_features(sales.daily_sales(_shop(spark, 30))).count() == 0


def test_features_match_pandas(spark):
    daily = sales.daily_sales(_shop(spark, 60, skip={5, 20}))
    got = {r["sales_date"]: r for r in rows(sales.sales_features(daily))}
    frame = daily.toPandas().sort_values("sales_date").reset_index(drop=True)
    revenue = frame["daily_revenue"].astype(float)
    expected = frame[["sales_date"]].copy()
    for lag in (1, 7, 14, 30):
        expected[f"revenue_lag_{lag}"] = revenue.shift(lag)
    for size in (7, 30):
        expected[f"revenue_ma_{size}"] = revenue.rolling(size).mean()
    expected["revenue_trend_7"] = revenue / expected["revenue_ma_7"]
    expected["revenue_growth"] = revenue.pct_change()
    expected = expected.dropna()
    assert set(got) == set(expected["sales_date"])
    for record in expected.to_dict("records"):
        for column, value in record.items():
            if column != "sales_date":
                assert float(got[record["sales_date"]][column]) == pytest.approx(value)


def test_calendar_flags(spark):
    got = rows(sales.sales_features(sales.daily_sales(_shop(spark, 75))))
    for r in got:
        date = r["sales_date"]
        assert r["is_weekend"] == int(date.weekday() >= 5)
        assert r["is_month_start"] == int(date.day <= 5)
        assert r["is_month_end"] == int(date.day >= 25)


def test_lagged_features_leave_out_the_current_day(spark):
    daily = sales.daily_sales(_shop(spark, 40))
    plain = {r["sales_date"]: r for r in rows(sales.sales_features(daily))}
    shifted = rows(sales.sales_features(daily, lagged=True))
    later = [r for r in shifted if r["sales_date"] - dt.timedelta(days=1) in plain]
    assert later
    for r in later:
        before = plain[r["sales_date"] - dt.timedelta(days=1)]
        assert r["revenue_ma_7"] == before["revenue_ma_7"]
        assert r["revenue_trend_7"] == before["revenue_trend_7"]


def test_zero_revenue_day_is_dropped_not_raised(spark):
    daily = sales.daily_sales(_shop(spark, 40)).withColumn(
        "daily_revenue",
        F.when(F.col("sales_date") == day("2024-02-05"), 0).otherwise(F.col("daily_revenue")),
    )
    dates = {r["sales_date"] for r in rows(sales.sales_features(daily))}
    assert day("2024-02-06") not in dates and day("2024-02-05") in dates


def test_split_is_chronological(spark):
    features = sales.sales_features(sales.daily_sales(_shop(spark, 41)))
    split = rows(forecast.chronological_split(features))
    flags = [r["is_test"] for r in sorted(split, key=lambda r: r["sales_date"])]
    assert flags == [False] * 8 + [True] * 3  # int(0.8 * 11) = 8


@pytest.fixture(scope="module")
def trained(spark):
    features = sales.sales_features(
        sales.daily_sales(_shop(spark, 90), ["payment_method"]), ["payment_method"]
    )
    model, metrics = forecast.train_forecast(features, ["payment_method"], trees=3)
    return features, model, rows(metrics)[0]


def test_metrics(trained):
    features, _, metrics = trained
    newest = features.agg(F.max("sales_date")).first()[0]
    assert 0 <= metrics["train_mape"] < 1 and 0 <= metrics["test_mape"] < 1
    finals = {float(r["daily_revenue"]) for r in rows(features.filter(F.col("sales_date") == newest))}
    assert metrics["last_actual"] in finals
    assert not math.isnan(metrics["last_predicted"])


def test_forecast_repeats_step_by_step(trained):
    """The chained forecast equals predicting one day at a time by hand."""
    features, model, _ = trained
    one_series = features.filter(F.col("payment_method") == "PayPal")
    got = sorted(rows(forecast.sales_forecast(model, one_series, 4)), key=lambda r: r["day_number"])
    spark = one_series.sparkSession
    state = rows(one_series.orderBy(F.desc("sales_date")).limit(1))[0]
    for step in got:
        inputs = {c: float(state[c]) for c in forecast.FORECAST_COLUMNS}
        predicted = model.transform(spark.createDataFrame([inputs])).first()["prediction"]
        state["sales_date"] += dt.timedelta(days=1)
        assert step["forecast_date"] == state["sales_date"]
        assert step["predicted_revenue"] == pytest.approx(predicted)
        state.update(revenue_lag_1=predicted, day_of_week=state["sales_date"].weekday(),
                     month=state["sales_date"].month)


def test_forecast_per_series(trained):
    features, model, _ = trained
    got = rows(forecast.sales_forecast(model, features, 2, ["payment_method"]))
    assert sorted((r["payment_method"], r["day_number"]) for r in got) == [
        ("PayPal", 1), ("PayPal", 2), ("iDEAL", 1), ("iDEAL", 2)
    ]


def test_no_data_and_no_model(trained):
    features, model, _ = trained
    assert rows(forecast.sales_forecast(model, features.filter("false"), 2)) == []
    with pytest.raises(ValueError):
        forecast.sales_forecast(None, features)
