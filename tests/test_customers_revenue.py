from dataclasses import replace
from decimal import Decimal

import pytest

from shop_data import AS_OF, day, frame, rows, shop
from pyspark.sql import functions as F

from shoplytic.operators import cohorts, customers, filters, kpis, revenue


def test_kpis(small):
    row = rows(kpis.kpi_summary(small))[0]
    assert row == {
        "total_customers": 5, "total_orders": 4, "active_products": 2,
        "total_revenue": Decimal("300.00"), "avg_order_value": 75.0, "active_customers": 3,
    }


def test_kpis_without_orders(spark, small):
    empty = small.with_orders(frame(spark, "orders", []))
    row = rows(kpis.kpi_summary(empty))[0]
    assert (row["total_orders"], row["total_revenue"], row["avg_order_value"]) == (0, 0, 0)
    raw = rows(kpis.kpi_summary(empty, zero_when_empty=False))[0]
    assert raw["total_revenue"] is None and raw["avg_order_value"] is None


def test_spending_keeps_customers_without_valid_orders(small):
    spent = {r["customer_id"]: (r["total_orders"], r["total_spent"])
             for r in rows(customers.customer_spending(small))}
    assert spent == {1: (2, 150), 2: (1, 150), 3: (0, 0), 4: (0, 0), 5: (1, 0)}


def test_ranking_ties_and_zero_spend(small):
    ranked = {r["customer_id"]: r for r in rows(customers.customer_ranking(small))}
    assert set(ranked) == {1, 2}
    assert [ranked[i]["overall_rank"] for i in (1, 2)] == [1, 2]
    assert [ranked[i]["rank_in_tier"] for i in (1, 2)] == [1, 1]
    assert sum(r["pct_of_total_revenue"] for r in ranked.values()) == 100


def test_concentration_needs_enough_customers(small):
    assert rows(customers.top_customer_concentration(small)) == []
    assert rows(customers.top_customer_concentration(small, 2))[0]["top_n_pct"] == 100


def test_tiers(small):
    assert rows(customers.tier_summary(small)) == [
        {"customer_tier": "Gold", "customers": 2, "total_spent": Decimal("300.00"),
         "total_orders": 3}
    ]
    assert rows(customers.paying_in_tier(small)) == [{"customers": 0}]
    assert rows(customers.tier_distribution(small))[0] == {
        "customer_tier": "Gold", "customer_count": 2
    }


def test_top_spenders(small):
    top = rows(customers.top_spenders(small, 3))
    assert [r["customer_id"] for r in top] == [1, 2, 3]
    assert rows(customers.top_spenders_summary(small)) == [
        {"customers": 5, "highest_spent": Decimal("150.00"), "most_orders": 2}
    ]
    assert rows(customers.top_customers(small))[0]["customer_name"] == "F1 L1"


def test_order_activity_counts_every_status(small):
    assert [r["total_orders"] for r in rows(customers.order_activity(small, AS_OF))] == [
        2, 1, 2, 0, 1
    ]


def test_filters(spark, small):
    ranked = customers.customer_ranking(small)
    assert filters.customers_filtered(ranked, []).count() == 2
    assert filters.customers_filtered(ranked, None).count() == 2
    assert filters.customers_filtered(ranked, ["Silver"]).count() == 0
    ids = spark.createDataFrame([(2,), (9,)], "customer_id long")
    assert [r["customer_id"] for r in rows(filters.by_id(ranked, "customer_id", ids))] == [2]
    assert [r["customer_id"] for r in rows(filters.by_id(ranked, "customer_id", [1]))] == [1]
    months = revenue.revenue_trend(small)
    both_ends = filters.revenue_filtered(months, day("2024-09-01"), day("2024-10-01"))
    assert both_ends.count() == 2
    assert filters.revenue_filtered(months, day("2024-09-01")).count() == 3
    assert filters.checked_top_n(20) == 20
    for wrong in (0, 3, 105):
        with pytest.raises(ValueError):
            filters.checked_top_n(wrong)


def test_revenue_trend(small):
    trend = rows(revenue.revenue_trend(small))
    assert [r["month"] for r in trend] == [
        day("2024-09-01"), day("2024-10-01"), day("2024-12-01")
    ]
    assert [r["cumulative_revenue"] for r in trend] == [150, 250, 300]
    assert [r["mom_growth_pct"] for r in trend] == [None, -33.3, -50.0]


def test_growth_after_a_month_of_zero_revenue(spark):
    t = shop(spark, orders=[
        {"order_id": 1, "customer_id": 1, "order_date": "2024-01-05",
         "order_status": "delivered", "total_amount": 0},
        {"order_id": 2, "customer_id": 1, "order_date": "2024-02-05",
         "order_status": "delivered", "total_amount": 9},
    ])
    assert [r["mom_growth_pct"] for r in rows(revenue.revenue_trend(t))] == [None, None]
    assert rows(revenue.revenue_status(revenue.revenue_trend(t)))[0]["status"] is None


@pytest.mark.parametrize(
    ("last", "status"), [(111, "Strong growth"), (110, "Stable growth"), (89, "Revenue decline")]
)
def test_revenue_status(spark, last, status):
    t = shop(spark, orders=[
        {"order_id": i, "customer_id": 1, "order_date": f"2024-0{i}-05",
         "order_status": "delivered", "total_amount": amount}
        for i, amount in [(1, 100), (2, last)]
    ])
    assert rows(revenue.revenue_status(revenue.revenue_trend(t)))[0]["status"] == status


def _months(spark, *starts):
    return spark.createDataFrame(
        [(day(s), Decimal(100 * (i + 1))) for i, s in enumerate(starts)],
        "month date, monthly_revenue decimal(18,2)",
    )


def test_linear_trend_needs_three_months(spark):
    two = _months(spark, "2025-01-01", "2025-02-01")
    assert rows(revenue.revenue_linear_trend(two)) == []
    assert rows(revenue.revenue_linear_forecast(two)) == []


@pytest.mark.parametrize(
    ("months", "first_end"),
    [
        (("2025-05-01", "2025-06-01", "2025-07-01"), "2025-07-31"),
        (("2025-04-01", "2025-05-01", "2025-06-01"), "2025-07-31"),
        (("2024-12-01", "2025-01-01", "2025-02-01"), "2025-03-31"),
    ],
)
def test_forecast_month_ends(spark, months, first_end):
    ends = [r["forecast_date"] for r in rows(revenue.revenue_linear_forecast(_months(spark, *months)))]
    assert len(ends) == 3 and min(ends) == day(first_end)


def test_linear_trend_values(spark):
    numpy = pytest.importorskip("numpy")
    df = _months(spark, "2025-01-01", "2025-02-01", "2025-04-01", "2025-05-01")
    got = rows(revenue.revenue_linear_trend(df))
    x = [r["day_offset"] for r in got]
    y = [r["monthly_revenue"] for r in got]
    slope, intercept = numpy.polyfit(x, y, 1)
    assert x == sorted(x) and x[0] == 0
    assert got[0]["slope"] == pytest.approx(slope)
    assert got[0]["intercept"] == pytest.approx(intercept)
    assert got[0]["r_squared"] == pytest.approx(numpy.corrcoef(x, y)[0, 1] ** 2)


def test_cohorts(small):
    cells = {(str(r["cohort_month"]), r["period_number"]): r["retention_rate"]
             for r in rows(cohorts.cohort_retention(small))}
    assert cells == {
        ("2024-09-01", 0): 100.0, ("2024-10-01", 0): 100.0, ("2024-10-01", 2): 100.0
    }
    assert cohorts.last_period(small) == 3
    matrix = rows(cohorts.cohort_matrix(cohorts.cohort_retention(small), 3))
    assert matrix[1] == {"cohort_month": day("2024-10-01"), "period_0": 100.0,
                         "period_1": None, "period_2": 100.0, "period_3": None}


def test_no_valid_orders(spark, small):
    t = replace(small, orders=small.orders.filter(F.col("order_status") == "pending"))
    assert rows(customers.customer_ranking(t)) == []
    assert rows(revenue.revenue_trend(t)) == []
    assert rows(cohorts.cohort_retention(t)) == []
    assert cohorts.last_period(t) == 0


def test_no_period_of_the_matrix_is_lost(spark):
    from shoplytic.operators import cohorts

    retention = spark.createDataFrame(
        [("2015-01-01", 0, 9, 100.0), ("2015-01-01", 108, 1, 11.1), ("2016-02-01", 0, 2, 100.0)],
        "cohort_month string, period_number int, active_customers long, retention_rate double",
    )
    matrix = cohorts.cohort_matrix(retention)
    assert matrix.columns == ["cohort_month", *[f"period_{p}" for p in range(109)]]
    assert matrix.first()["period_108"] == 11.1
    assert len(cohorts.cohort_matrix(retention.filter("false")).columns) == 2


def test_averages_leave_out_null_amounts(spark):
    from shoplytic.operators import churn, kpis

    t = shop(
        spark,
        customers=[{"customer_id": 1, "customer_tier": "Gold", "registration_date": "2024-01-01"}],
        orders=[
            {"order_id": o, "customer_id": 1, "order_date": "2024-12-01",
             "order_status": "delivered", "total_amount": amount}
            for o, amount in [(1, None), (2, 10)]
        ],
    )
    assert rows(kpis.kpi_summary(t))[0]["avg_order_value"] == 10.0
    for grain in ("line", "order"):
        got = rows(churn.churn_features(t, AS_OF, grain=grain))[0]
        assert (got["avg_order_value"], got["total_orders"]) == (10.0, 2)
