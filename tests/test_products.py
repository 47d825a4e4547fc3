import itertools
import random
from collections import Counter
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from shop_data import rows, shop
from shoplytic.operators import affinity, products


def test_performance(small):
    got = {r["product_id"]: r for r in rows(products.product_performance(small))}
    assert set(got) == {10, 11}
    coat = got[11]
    assert coat["times_ordered"] == 3 and coat["total_units_sold"] == 4
    assert coat["total_revenue"] == Decimal("195.01")
    # (50.01 + 50 + 50) / 3 = 50.0033; profit 30.0033; times 4 units = 120.0133
    assert coat["avg_selling_price"] == Decimal("50.00")
    assert coat["profit_per_unit"] == Decimal("30.00")
    assert coat["total_profit"] == Decimal("120.01")
    assert coat["revenue_rank"] == 1 and got[10]["revenue_rank"] == 2
    assert coat["pct_of_total_revenue"] + got[10]["pct_of_total_revenue"] == pytest.approx(100)


def test_quartiles(small):
    got = {r["product_id"]: r for r in rows(products.product_quartiles(small))}
    assert got[10]["unique_customers"] == 2 and got[10]["avg_profit_margin"] == 40.0
    assert (got[11]["performance_quartile"], got[10]["performance_quartile"]) == (1, 2)


def test_summaries(small):
    by_category = {r["category_name"]: r for r in rows(products.category_summary(small))}
    assert by_category["Clothing"]["total_profit"] == Decimal("120.01")
    assert rows(products.brand_share(small, "Nobody")) == []
    assert rows(products.brand_share(small, "Wool"))[0]["products"] == 1
    assert [r["product_id"] for r in rows(products.top_products(small, 1))] == [11]
    assert rows(products.above_median_profit(small)) == [{"products": 1}]


def test_quadrants(small):
    got = {r["product_id"]: r["quadrant"] for r in rows(products.product_quadrants(small))}
    assert got == {10: "Low Volume / High Profit", 11: "High Volume / Low Profit"}
    assert len(rows(products.product_quadrants(small, 1))) == 1


def test_filter_domains(small):
    got = {(r["domain"], r["value"]) for r in rows(products.filter_domains(small))}
    assert got == {
        ("first_month", "2024-09-01"), ("last_month", "2024-12-01"), ("customer_tier", "Gold"),
        ("category_name", "Electronics"), ("category_name", "Clothing"),
    }


def _basket_shop(spark, baskets):
    return shop(
        spark,
        orders=[
            {"order_id": i, "customer_id": 1, "order_date": "2024-01-01",
             "order_status": "delivered", "total_amount": 1}
            for i in range(len(baskets))
        ],
        order_items=[
            {"order_item_id": n, "order_id": i, "product_id": p, "quantity": 1,
             "unit_price": 1, "line_total": 1, "discount_applied": 0}
            for i, basket in enumerate(baskets)
            for n, p in enumerate(basket)
        ],
    )


@pytest.mark.parametrize(("threshold", "ordinary"), [(2, 32), (3, 32), (2, 0), (5, 0)])
def test_affinity_equals_brute_force(spark, monkeypatch, threshold, ordinary):
    monkeypatch.setattr(affinity, "BLOCK_ROWS", 7)
    rng = random.Random(threshold)
    baskets = [rng.choices(range(12), k=rng.randint(1, 5)) for _ in range(60)]
    # Baskets that hold most of all lines, and a repeated product inside one basket.
    baskets += [list(range(60)), list(range(60)), [1, 1, 2]]
    # Several huge baskets that overlap in part.
    baskets += [list(range(start, start + 50)) for start in (0, 100, 120, 140, 190)]
    counts = Counter()
    single = Counter()
    for basket in baskets:
        distinct = sorted(set(basket))
        single.update(distinct)
        counts.update(itertools.combinations(distinct, 2))
    expected = {pair: n for pair, n in counts.items() if n >= threshold}

    got = rows(affinity.product_affinity(_basket_shop(spark, baskets), threshold, ordinary))
    assert {(r["product_a"], r["product_b"]): r["pair_orders"] for r in got} == expected
    n = len(baskets)
    for r in got:
        a, b = single[r["product_a"]], single[r["product_b"]]
        assert r["support"] == pytest.approx(r["pair_orders"] / n)
        assert r["confidence_a_to_b"] == pytest.approx(r["pair_orders"] / a)
        assert r["confidence_b_to_a"] == pytest.approx(r["pair_orders"] / b)
        assert r["lift"] == pytest.approx(r["pair_orders"] * n / (a * b))


def test_affinity_threshold(small):
    with pytest.raises(ValueError):
        affinity.product_affinity(small, 1)


def test_no_candidate_below_the_threshold_is_pinned_without_tails(spark):
    baskets = [[1, 2, 3], [1, 2], [2, 3], [4, 5]]
    lines = spark.createDataFrame(
        [(i, p, len(b)) for i, b in enumerate(baskets) for p in b],
        "order_id long, product_id long, size long",
    )
    tails = lines.filter("false").select("order_id", "product_id")
    got = affinity._candidates(lines, tails, 2).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 2), (2, 3, 2)]


def test_pairs_of_a_huge_basket_come_from_many_tasks(spark):
    lines = spark.range(1500).selectExpr("1L AS order_id", "id AS product_id", "1500L AS size")
    pairs = affinity._block_pairs(lines).withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert sum(per_task) == 1500 * 1499 // 2
    assert len(per_task) == 8 and max(per_task) < sum(per_task) / 3
