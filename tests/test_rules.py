import datetime as dt
import json
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shop_data import AS_OF, frame, rows, shop
from shoplytic.operators import churn, insights, pricing, quality
from shoplytic.plans.dashboard import dashboard_payload


def _orders(spark, *months):
    return shop(
        spark,
        customers=[{"customer_id": 1, "customer_tier": "Gold", "registration_date": "2020-01-01"}],
        orders=[{"order_id": n, "customer_id": 1, "order_date": date, "order_status": "shipped",
                 "total_amount": amount} for n, (date, amount) in enumerate(months)],
    )


@pytest.mark.parametrize(
    ("months", "title"),
    [
        ([("2024-11-05", 100), ("2024-12-05", 111)], "Strong Growth Detected"),
        ([("2024-11-05", 100), ("2024-12-05", 110)], None),
        ([("2024-11-05", 100), ("2024-12-05", 90)], None),
        ([("2024-11-05", 100), ("2024-12-05", 89)], "Revenue Decline Alert"),
        ([("2024-12-05", 100)], None),
        # The older month is outside the trailing three months.
        ([("2024-09-30", 100), ("2024-12-05", 500)], None),
        ([("2024-10-01", 100), ("2024-12-05", 500)], "Strong Growth Detected"),
        ([("2024-11-05", 0), ("2024-12-05", 500)], None),
    ],
)
def test_revenue_insight(spark, months, title):
    t = _orders(spark, *months)
    found = rows(insights.revenue_insight(insights.revenue_trend_signal(t, AS_OF)))
    assert [r["title"] for r in found] == ([title] if title else [])


def test_insight_texts(spark):
    t = _orders(spark, ("2024-11-05", 100), ("2024-12-05", 75))
    assert rows(insights.business_insights(t, AS_OF)) == [
        {"type": "warning", "title": "Revenue Decline Alert",
         "message": "Revenue decreased by 25.0% last month.",
         "action": "Investigate causes and implement recovery strategies."}
    ]


def test_retention_insight(spark):
    t = _orders(spark, *[(f"2024-0{m}-05", 10) for m in (5, 6, 7)])
    features = churn.churn_features(t, AS_OF, grain="order")
    assert rows(insights.retention_insight(features))[0]["message"].startswith("1 customers")


def test_insights_without_tables(spark, small):
    record = rows(insights.business_insights(replace(small, orders=None), AS_OF))
    assert [r["type"] for r in record] == ["info"]


def test_payload(small):
    when = dt.datetime(2025, 1, 1, 12, 30)
    got = json.loads(rows(dashboard_payload(small, when))[0]["payload"])
    assert got == {"revenueForecast": 300.0, "modelAccuracy": 0.982, "activeCustomers": 3,
                   "predictionsToday": 4, "lastUpdated": "2025-01-01T12:30:00Z",
                   "status": "live"}
    got = json.loads(rows(dashboard_payload(small, when, 0.9, 342))[0]["payload"])
    assert (got["modelAccuracy"], got["predictionsToday"]) == (0.9, 342)


def test_payload_without_orders(spark, small):
    empty = small.with_orders(frame(spark, "orders", []))
    assert json.loads(rows(dashboard_payload(empty, dt.datetime(2025, 1, 1)))[0]["payload"])[
        "revenueForecast"] == 0


def test_order_totals(spark):
    t = shop(
        spark,
        customers=[{"customer_id": 1, "customer_tier": "Gold"},
                   {"customer_id": 2, "customer_tier": "Platinum"}],
        orders=[{"order_id": o, "customer_id": c} for o, c in [(10, 1), (60, 1), (25, 2), (7, 9)]],
        order_items=[
            {"order_id": o, "quantity": 1, "unit_price": p, "line_total": p}
            for o, p in [(10, 50), (60, "50.01"), (25, 100), (25, "99.99")]
        ],
    )
    got = {r["order_id"]: r for r in rows(pricing.order_totals(t))}
    assert got[10]["shipping_cost"] == Decimal("5.95")  # exactly 50 is not free
    assert got[60]["shipping_cost"] == 0
    assert got[10]["discount_amount"] == Decimal("2.50")
    assert got[60]["eligible_discount"] == Decimal("2.50") and got[60]["discount_amount"] == 0
    assert got[25]["discount_amount"] == Decimal("20.00")
    assert got[25]["tax_amount"] == Decimal("42.00")
    assert got[25]["total_amount"] == Decimal("221.99")
    assert got[7]["tier"] == "Bronze" and got[7]["total_amount"] == Decimal("5.95")


def test_labels(small):
    labels = {r["product_id"]: r for r in rows(pricing.product_labels(small))}
    assert labels[10]["sku"] == "ACM-10010"
    assert labels[10]["description"] == "High-quality Phone from Acme"
    assert rows(pricing.customer_labels(small))[0]["email"] == "f1.l12@example.com"


def test_combined_catalogue(small):
    named = small.products.select("product_id", "category_id")
    lists = {
        "Electronics": named.filter(F.col("product_id") == 10),
        "Garden": named.filter(F.col("product_id") != 10),
    }
    got = {r["product_id"]: (r["category_name"], r["category_id"])
           for r in rows(pricing.combined_catalogue(lists, small.categories, "Clothing"))}
    assert got == {10: ("Electronics", 1), 11: ("Clothing", 2), 12: ("Clothing", 2)}
    plain = {r["product_id"]: r["category_id"]
             for r in rows(pricing.combined_catalogue(lists, small.categories))}
    assert plain == {10: 1, 11: None, 12: None}


def test_quality_report(spark):
    t = shop(
        spark,
        customers=[{"customer_id": 1, "customer_tier": "Gold"},
                   {"customer_id": 2, "customer_tier": "Tin"}],
        categories=[{"category_id": 1, "category_name": "Electronics"}],
        products=[{"product_id": 1, "category_id": 1}, {"product_id": 2, "category_id": 9}],
        customer_addresses=[{"customer_id": 1, "is_primary": True},
                            {"customer_id": 1, "is_primary": True},
                            {"customer_id": 8, "is_primary": False}],
        orders=[
            {"order_id": 1, "customer_id": 1, "order_status": "shipped", "subtotal": 19,
             "tax_amount": 4, "shipping_cost": 0, "discount_amount": 1, "total_amount": 22},
            {"order_id": 2, "customer_id": 7, "order_status": "lost", "subtotal": 3,
             "tax_amount": 0, "shipping_cost": 0, "discount_amount": 0, "total_amount": 4},
        ],
        order_items=[
            {"order_id": 1, "product_id": 1, "quantity": 2, "unit_price": 10,
             "discount_applied": 1, "line_total": 19},
            {"order_id": 5, "product_id": 5, "quantity": 0, "unit_price": 10,
             "discount_applied": 0, "line_total": 9},
            {"order_id": 5, "product_id": 1, "quantity": 1, "unit_price": 9,
             "discount_applied": 0, "line_total": 9},
        ],
    )
    got = {(r["table"], r["rule"]): r["violations"] for r in rows(quality.quality_report(t))}
    assert got == {
        ("order_items", "line_total_matches"): 1,
        ("order_items", "quantity_positive"): 1,
        ("orders", "total_matches"): 1,
        ("orders", "status_known"): 1,
        ("orders", "subtotal_matches"): 1,
        ("customers", "tier_known"): 1,
        ("orders", "customer_exists"): 1,
        ("order_items", "order_exists"): 2,
        ("order_items", "product_exists"): 1,
        ("products", "category_exists"): 1,
        ("customer_addresses", "customer_exists"): 1,
        ("customer_addresses", "one_primary_address"): 2,
    }
