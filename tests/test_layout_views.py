from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shop_data import AS_OF, frame, shop
from shoplytic.operators import churn, insights, sales
from shoplytic.schema import ORDER_ITEMS, ORDERS, Tables
from shoplytic.sources import layout, maintained

TIERS = ["Gold", "Silver", "Bronze"]


def made_orders(days, first="2024-01-01", each=8, start=0):
    pick = random.Random(start + 5)
    begin = dt.date.fromisoformat(first)
    return [
        {
            "order_id": start + n * each + k,
            "customer_id": pick.choice([None, *range(1, 13)]),
            "order_date": (begin + dt.timedelta(days=n)).isoformat(),
            "order_status": pick.choice(["delivered", "shipped", "cancelled"]),
            "payment_method": pick.choice([None, "PayPal", "iDEAL"]),
            "total_amount": pick.choice([None, 10, "25.50", 99, 15, 20]),
            "discount_amount": pick.choice([None, 0, 2]),
        }
        for n in range(days)
        for k in range(each)
    ]


def made_lines(orders):
    pick = random.Random(9)
    return [
        {"order_item_id": o["order_id"] * 2 + k, "order_id": o["order_id"],
         "product_id": pick.randrange(6), "quantity": 1, "unit_price": 5, "line_total": 5}
        for o in orders
        for k in range(pick.randrange(3))
    ]


def made(spark, days, **options):
    orders = made_orders(days, **options)
    customers = [
        {"customer_id": i, "customer_tier": TIERS[i % 3], "registration_date": "2023-01-01"}
        for i in range(1, 13)
    ]
    return shop(spark, customers=customers, orders=orders, order_items=made_lines(orders))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folders_read(df):
    return {p for (f,) in df.select(F.input_file_name()).distinct().collect()
            for p in f.split("/") if p.startswith("order_")}


def by_customer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("laid") / "orders")
    t = made(spark, 366)
    layout.write_orders(t, path)
    return t, layout.read_rows(spark, path, ORDERS)


def test_layout_keeps_every_order(laid):
    t, orders = laid
    assert by_customer(orders.select(*t.orders.columns)) == by_customer(t.orders)


def test_date_filters_read_their_months(laid):
    t, orders = laid
    some = layout.in_dates(orders, dt.date(2024, 3, 20), dt.date(2024, 4, 2))
    assert {f for f in folders_read(some) if "month" in f} == {
        "order_month=2024-03-01", "order_month=2024-04-01"
    }
    expected = t.orders.filter(F.col("order_date").between("2024-03-20", "2024-04-02"))
    assert by_customer(some.select(*t.orders.columns)) == by_customer(expected)
    # Operators pass their dates on.
    recent = insights.recent_monthly_revenue(t.with_orders(orders), AS_OF)
    assert "order_month" in plan_of(recent).split("PartitionFilters: ")[1].split("]")[0]
    assert by_customer(recent) == by_customer(insights.recent_monthly_revenue(t, AS_OF))
    features = churn.churn_features_at_horizon(t.with_orders(orders), AS_OF)
    assert by_customer(features) == by_customer(churn.churn_features_at_horizon(t, AS_OF))


def test_tier_filters_read_their_folders(laid):
    t, orders = laid
    gold = layout.in_tiers(orders, ["Gold"])
    assert {f for f in folders_read(gold) if "tier" in f} == {"order_tier=Gold"}
    ids = t.customers.filter("customer_tier = 'Gold'").select("customer_id")
    assert gold.count() == t.orders.join(ids, "customer_id").count()


def test_chosen_periods_prune_while_the_query_runs(spark, laid):
    _, orders = laid
    calendar = spark.range(12).select(
        F.add_months(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("order_month")
    )
    quarter = calendar.filter(F.quarter("order_month") == 2)
    some = layout.in_periods(orders, quarter)
    assert "dynamicpruning" in plan_of(some)
    assert {f for f in folders_read(some) if "month" in f} == {
        f"order_month=2024-0{m}-01" for m in (4, 5, 6)
    }


def test_a_wrong_period_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="order_week"):
        layout.write_orders(made(spark, 1), str(tmp_path / "x"), by="order_week")


class Kept:
    """A shop in a layout by day, with its views."""

    def __init__(self, spark, tmp_path):
        self.spark, self.tmp = spark, tmp_path
        self.parts = []

    def add(self, t, mode="append"):
        layout.write_orders(t, str(self.tmp / "orders"), layout.DAY, mode)
        layout.write_lines(t, str(self.tmp / "lines"), layout.DAY, mode)
        self.parts.append(t)

    def tables(self):
        first = self.parts[0]
        return Tables(
            customers=first.customers,
            orders=layout.read_rows(self.spark, str(self.tmp / "orders"), ORDERS, layout.DAY),
            order_items=layout.read_rows(
                self.spark, str(self.tmp / "lines"), ORDER_ITEMS, layout.DAY
            ),
        )

    def views(self, root="views"):
        return maintained.FeatureViews(self.spark, str(self.tmp / root), layout.DAY)

    def check(self, views):
        """The views equal the operators over all orders, and a full rebuild."""
        whole = Tables(
            customers=self.parts[0].customers,
            orders=self.tables().orders.drop(layout.DAY),
            order_items=self.tables().order_items.drop(layout.DAY),
        )
        features = churn.churn_features(whole, AS_OF, grain="order")
        got = views.customer_features(whole.customers, AS_OF)
        assert got.columns == features.columns and by_customer(got) == by_customer(features)
        daily = sales.sales_features(sales.daily_sales(whole))
        assert by_customer(views.daily_features()) == by_customer(daily)
        fresh = self.views(f"fresh-{random.random()}")
        fresh.publish(self.tables())
        assert by_customer(fresh.daily_features()) == by_customer(daily)


def test_a_new_day_reads_one_day(spark, tmp_path):
    kept = Kept(spark, tmp_path)
    kept.add(made(spark, 45))
    views = kept.views()
    first = views.publish(kept.tables())
    assert first.version == 0 and len(first.periods) == 45
    kept.check(views)
    # Nothing new: the version stays.
    assert views.publish(kept.tables()) == maintained.Published(0, ())

    kept.add(made(spark, 1, first="2024-02-15", start=9000))
    new_day = dt.date(2024, 2, 15)
    part = views.part_of(kept.tables(), [new_day])
    assert folders_read(part.orders) == {"order_day=2024-02-15"}
    assert "PartitionFilters: [" in plan_of(part.orders)
    # A reader of before keeps its version until the publish is whole.
    old, rows = views.daily_features(), by_customer(views.daily_features())
    assert len(rows) > 10
    assert views.publish(kept.tables()) == maintained.Published(1, (new_day,))
    assert by_customer(old) == rows
    kept.check(views)
    # A session that starts later sees the same.
    kept.check(kept.views())


def test_changed_and_vanished_days(spark, tmp_path):
    kept = Kept(spark, tmp_path)
    kept.add(made(spark, 40))
    views = kept.views()
    views.publish(kept.tables())
    # More orders of an old day.
    kept.add(made(spark, 1, first="2024-01-10", start=5000))
    assert views.publish(kept.tables()).periods == (dt.date(2024, 1, 10),)
    kept.check(views)
    # The whole layout written anew, with fewer days.
    kept.add(made(spark, 35, start=700), "overwrite")
    assert len(views.publish(kept.tables()).periods) == 35
    kept.check(views)


def test_a_publish_that_fails_is_not_seen(spark, tmp_path):
    kept = Kept(spark, tmp_path)
    kept.add(made(spark, 33))
    views = kept.views()
    views.publish(kept.tables())
    kept.add(made(spark, 1, first="2024-03-01", start=9000))
    views.manifests.add_all = lambda entries: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        views.publish(kept.tables())
    before = kept.views()
    assert before.customer_days().filter("order_date = DATE'2024-03-01'").isEmpty()
    # The next publish replaces what the failed one left.
    assert before.publish(kept.tables()) == maintained.Published(1, (dt.date(2024, 3, 1),))
    kept.check(before)


def test_views_before_any_publish(spark, tmp_path):
    views = Kept(spark, tmp_path).views()
    assert views.daily_features().collect() == []
    assert frame(spark, "orders", []).count() == 0


def test_lines_of_other_orders_are_dropped_before_the_join(spark):
    lines = spark.range(20_000).select((F.col("id") % 10_000).alias("order_id"), "id")
    orders = spark.range(100).select(F.col("id").alias("order_id"))
    orders = orders.union(orders).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    likely = layout.likely_lines(lines.union(spark.sql("SELECT NULL, -1L")), orders)
    assert likely.columns == lines.columns
    assert likely.join(orders.distinct(), "order_id").count() == 200
    assert likely.count() < 220
    assert layout.likely_lines(lines, orders.filter("false")).count() == 0
