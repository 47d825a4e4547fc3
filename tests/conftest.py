from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shoplytic import session  # noqa: E402
from shoplytic.schema import Tables  # noqa: E402
from shop_data import shop  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        session.builder("shoplytic-tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def many_slices(spark):
    """Keep small shuffles in all their partitions, as large data would be."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


@pytest.fixture(scope="session")
def small(spark) -> Tables:
    """Customers: 1 buys twice, 2 ties with 1, 3 only cancelled, 4 nothing, 5 no items."""
    return shop(
        spark,
        customers=[
            {"customer_id": i, "first_name": f"F{i}", "last_name": f"L{i}",
             "customer_tier": tier, "registration_date": registered}
            for i, tier, registered in [
                (1, "Gold", "2024-01-01"),
                (2, "Gold", "2024-01-01"),
                (3, "Bronze", "2024-01-01"),
                (4, "Silver", "2024-12-02"),
                (5, "Platinum", "2024-12-03"),
            ]
        ],
        categories=[
            {"category_id": 1, "category_name": "Electronics"},
            {"category_id": 2, "category_name": "Clothing"},
        ],
        products=[
            {"product_id": 10, "product_name": "Phone", "brand": "Acme", "category_id": 1,
             "unit_cost": 60, "selling_price": 100, "is_active": True},
            {"product_id": 11, "product_name": "Coat", "brand": "Wool", "category_id": 2,
             "unit_cost": 20, "selling_price": 50, "is_active": True},
            {"product_id": 12, "product_name": "Hat", "brand": "Wool", "category_id": 2,
             "unit_cost": 5, "selling_price": 10, "is_active": False},
        ],
        orders=[
            {"order_id": o, "customer_id": c, "order_date": d, "order_status": s,
             "payment_method": p, "total_amount": a, "discount_amount": x}
            for o, c, d, s, p, a, x in [
                (100, 1, "2024-10-03", "delivered", "PayPal", 100, 0),
                (101, 1, "2024-12-31", "shipped", "iDEAL", 50, 5),
                (102, 2, "2024-09-03", "confirmed", "PayPal", 150, 10),
                (103, 3, "2024-12-01", "cancelled", "PayPal", 999, 0),
                (104, 3, "2024-12-01", "pending", "PayPal", 999, 0),
                (105, 5, "2024-09-02", "delivered", "iDEAL", 0, 0),
            ]
        ],
        order_items=[
            {"order_item_id": n, "order_id": o, "product_id": p, "quantity": q,
             "unit_price": u, "line_total": t, "discount_applied": d}
            for n, o, p, q, u, t, d in [
                (1, 100, 10, 1, 100, 100, 0),
                (2, 100, 11, 1, "50.01", "45.01", 5),
                (3, 101, 11, 1, 50, 50, 0),
                (4, 102, 10, 1, 100, 90, 10),
                (5, 102, 11, 2, 50, 100, 0),
                (6, 103, 12, 9, 10, 90, 0),
            ]
        ],
    )
