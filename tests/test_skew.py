"""One customer, one product and one order each hold a third of the rows.

The operators are compared with the plain joins they stand for, with thresholds so
low that skew splitting and many small partitions really happen.
"""

import random
from decimal import Decimal

import pytest

from shop_data import AS_OF, rows, shop
from shoplytic.operators import churn, customers, products, sales
from shoplytic.sources.tables import query

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@pytest.fixture(scope="module")
def skewed(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    rng = random.Random(1)
    orders = [
        {"order_id": i, "customer_id": 1 if i % 3 == 0 else rng.randint(2, 40),
         "order_date": f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
         "order_status": rng.choice(["shipped", "delivered", "pending"]) if i else "shipped",
         "payment_method": rng.choice(["PayPal", "iDEAL"]),
         "total_amount": rng.randint(1, 90), "discount_amount": rng.choice([0, 2])}
        for i in range(300)
    ]
    items = [
        {"order_item_id": n, "order_id": 0 if n % 3 == 0 else rng.randint(0, 280),
         "product_id": 1 if n % 3 == 1 else rng.randint(2, 30), "quantity": rng.randint(1, 3),
         "unit_price": f"{rng.randint(1, 9)}.5", "line_total": rng.randint(1, 30),
         "discount_applied": 0}
        for n in range(3000)
    ]
    made = shop(
        spark,
        customers=[{"customer_id": i, "customer_tier": rng.choice(["Gold", "Silver"]),
                    "first_name": "a", "last_name": "b", "registration_date": "2023-01-01"}
                   for i in range(1, 45)],
        categories=[{"category_id": 1, "category_name": "Electronics"}],
        products=[{"product_id": i, "product_name": "p", "brand": "b", "category_id": 1,
                   "unit_cost": 1} for i in range(1, 31)],
        orders=orders,
        order_items=items,
    )
    made.order_items.createOrReplaceTempView("order_items")
    yield made
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def by(df, key):
    return {r[key]: r for r in rows(df)}


VALID = "o.order_status IN ('confirmed', 'shipped', 'delivered')"


def test_line_grain_equals_the_multiplying_join(skewed):
    plain = by(query(skewed, f"""
        SELECT c.customer_id, count(o.order_id) AS total_orders,
               coalesce(sum(o.total_amount), 0) AS total_spent,
               count(CASE WHEN o.discount_amount > 0 THEN 1 END) AS discount_orders,
               count(DISTINCT i.product_id) AS unique_products,
               count(DISTINCT o.payment_method) AS payment_methods_used
        FROM customers c
        LEFT JOIN orders o ON o.customer_id = c.customer_id AND {VALID}
        LEFT JOIN order_items i ON i.order_id = o.order_id
        GROUP BY c.customer_id"""), "customer_id")
    got = by(churn.churn_features(skewed, AS_OF), "customer_id")
    assert set(got) == set(plain) and len(got) == 44
    for key, row in plain.items():
        for column, value in row.items():
            assert got[key][column] == value, (key, column)


def test_products_equal_the_plain_join(skewed):
    plain = by(query(skewed, f"""
        SELECT p.product_id, count(i.order_item_id) AS times_ordered,
               sum(i.quantity) AS total_units_sold, sum(i.line_total) AS total_revenue,
               rank() OVER (ORDER BY sum(i.line_total) DESC) AS revenue_rank
        FROM products p JOIN order_items i ON i.product_id = p.product_id
        JOIN orders o ON o.order_id = i.order_id WHERE {VALID} GROUP BY p.product_id"""),
        "product_id")
    got = by(products.product_performance(skewed), "product_id")
    assert set(got) == set(plain)
    for key, row in plain.items():
        for column, value in row.items():
            assert got[key][column] == value, (key, column)


def test_ranking_and_days(skewed):
    ranked = by(customers.customer_ranking(skewed), "customer_id")
    assert ranked[1]["overall_rank"] == 1
    spent = sum((r["total_spent"] for r in ranked.values()), Decimal(0))
    days = rows(sales.daily_sales(skewed))
    assert sum(r["daily_revenue"] for r in days) == spent
    assert sum(r["order_count"] for r in days) == sum(r["total_orders"] for r in ranked.values())


def test_the_hot_order_is_split(skewed):
    lines = products.sold_items(skewed, "customer_id")
    lines.count()
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
