"""Churn features per customer and the reports built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.functions.dates import day, days_before
from shoplytic.functions.numeric import as_number, mean_of, ratio_or_zero
from shoplytic.operators.products import sold_items
from shoplytic.schema import Tables, valid_orders
from shoplytic.sources.layout import in_dates

# Windows in days, and the at-risk band (both ends excluded).
MIN_TENURE_DAYS = 30
ACTIVE_DAYS = 90
CHURN_DAYS = 120
AT_RISK_AFTER_DAYS = 90
AT_RISK_BEFORE_DAYS = 365
AT_RISK_MIN_ORDERS = 2

# Model inputs in their training order.
MODEL_COLUMNS = (
    "customer_tier_encoded",
    "days_since_registration",
    "total_orders",
    "total_spent",
    "avg_order_value",
    "days_since_last_order",
    "orders_last_90_days",
    "spent_last_90_days",
    "unique_products",
    "payment_methods_used",
    "discount_orders",
    "avg_discount_used",
    "order_frequency",
    "recent_activity_ratio",
    "spending_per_day",
)


def _weighted_orders(t: Tables, grain: str) -> DataFrame:
    """Valid orders with the number of times each one counts.

    At line grain an order counts once per line (once if it has none), which is
    what joining lines before aggregating does. Weighting gives the same sums
    without multiplying the rows.
    """
    orders = valid_orders(t)
    if grain == "order":
        return orders.withColumn("weight", F.lit(1).cast("long"))
    if grain != "line":
        raise ValueError(f"grain must be 'line' or 'order', got {grain!r}")
    lines = t.order_items.groupBy("order_id").agg(F.count("*").alias("lines"))
    return orders.join(lines, "order_id", "left").withColumn(
        "weight", F.coalesce("lines", F.lit(1).cast("long"))
    )


def _order_features(orders: DataFrame, recent_from: dt.date) -> DataFrame:
    weight = F.col("weight")
    amount = F.col("total_amount") * weight
    recent = F.col("order_date") >= day(recent_from)
    discounted = F.col("discount_amount") > 0
    return orders.groupBy("customer_id").agg(
        F.sum(weight).alias("total_orders"),
        F.sum(amount).alias("total_spent"),
        F.sum(F.when(F.col("total_amount").isNotNull(), weight)).alias("amounts"),
        F.max("order_date").alias("last_valid_order"),
        F.sum(F.when(recent, weight)).alias("orders_last_90_days"),
        F.sum(F.when(recent, amount)).alias("spent_last_90_days"),
        F.countDistinct("payment_method").alias("payment_methods_used"),
        F.sum(F.when(discounted, weight)).alias("discount_orders"),
        F.sum(F.when(discounted, F.col("discount_amount") * weight)).alias("discount_sum"),
    )


def _product_counts(t: Tables) -> DataFrame:
    return sold_items(t, "customer_id").groupBy("customer_id").agg(
        F.countDistinct("product_id").alias("unique_products")
    )


def churn_features(
    t: Tables,
    as_of: dt.date,
    grain: str = "line",
    min_tenure: int = MIN_TENURE_DAYS,
    active_days: int = ACTIVE_DAYS,
    churn_days: int = CHURN_DAYS,
) -> DataFrame:
    """Behaviour of every customer with enough tenure, and whether they churned.

    A customer has churned with no valid order in the last ``churn_days``.
    Orders and lines are each summed per customer before meeting the customer
    table, so both joins to it are on unique keys.
    """
    orders = _order_features(_weighted_orders(t, grain), days_before(as_of, active_days))
    return assembled_features(
        t.customers, orders, _product_counts(t), as_of, min_tenure, churn_days
    )


def assembled_features(
    customers: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    as_of: dt.date,
    min_tenure: int = MIN_TENURE_DAYS,
    churn_days: int = CHURN_DAYS,
) -> DataFrame:
    """``churn_features`` from sums per customer, however they were come by."""
    today = day(as_of)
    zero = F.lit(0).cast("long")
    no_money = F.lit(0).cast("decimal(38,2)")
    last = F.coalesce("last_valid_order", "registration_date")
    lapsed = F.col("last_valid_order") < day(days_before(as_of, churn_days))
    return (
        customers.filter(F.datediff(today, "registration_date") >= min_tenure)
        .join(orders, "customer_id", "left")
        .join(products, "customer_id", "left")
        .select(
            "customer_id",
            "customer_tier",
            F.datediff(today, "registration_date").alias("days_since_registration"),
            F.coalesce("total_orders", zero).alias("total_orders"),
            F.coalesce("total_spent", no_money).alias("total_spent"),
            F.coalesce(mean_of(F.col("total_spent"), F.col("amounts")), F.lit(0.0)).alias(
                "avg_order_value"
            ),
            last.alias("last_order_date"),
            F.datediff(today, last).alias("days_since_last_order"),
            F.coalesce("orders_last_90_days", zero).alias("orders_last_90_days"),
            F.coalesce("spent_last_90_days", no_money).alias("spent_last_90_days"),
            F.coalesce("unique_products", zero).alias("unique_products"),
            F.coalesce("payment_methods_used", zero).alias("payment_methods_used"),
            F.coalesce("discount_orders", zero).alias("discount_orders"),
            F.coalesce(
                mean_of(F.col("discount_sum"), F.col("discount_orders")), F.lit(0.0)
            ).alias("avg_discount_used"),
            F.when(lapsed | F.col("last_valid_order").isNull(), 1).otherwise(0).alias("is_churned"),
        )
    )


def churn_features_at_horizon(
    t: Tables, as_of: dt.date, horizon_days: int = CHURN_DAYS, grain: str = "line"
) -> DataFrame:
    """Features known ``horizon_days`` ago, labelled by what happened since.

    In ``churn_features`` the recency column decides the label. Here the label
    comes from a period the features cannot see.
    """
    cutoff = days_before(as_of, horizon_days)
    known = t.with_orders(in_dates(t.orders, last=cutoff))
    came_back = (
        in_dates(valid_orders(t), cutoff + dt.timedelta(days=1), as_of)
        .select("customer_id")
        .distinct()
        .withColumn("returned", F.lit(True))
    )
    features = churn_features(known, cutoff, grain=grain).drop("is_churned")
    return features.join(came_back, "customer_id", "left").select(
        *features.columns,
        F.when(F.col("returned"), 0).otherwise(1).alias("is_churned"),
    )


def churn_ratios(features: DataFrame) -> DataFrame:
    """Add order frequency, recent activity and spending per day; make inputs numeric."""
    tenure = F.col("days_since_registration")
    orders = F.col("total_orders")
    derived = features.select(
        "*",
        ratio_or_zero(orders, tenure / F.lit(30.0)).alias("order_frequency"),
        ratio_or_zero(F.col("orders_last_90_days"), orders).alias("recent_activity_ratio"),
        ratio_or_zero(F.col("total_spent"), tenure).alias("spending_per_day"),
    )
    inputs = [c for c in MODEL_COLUMNS if c != "customer_tier_encoded"]
    numbers = [
        (as_number(F.col(c)) if c in derived.columns else F.lit(0.0)).alias(c) for c in inputs
    ]
    return derived.select("customer_id", "customer_tier", *numbers, "is_churned")


def churn_model_inputs(features: DataFrame) -> DataFrame:
    """The numeric model inputs; tiers are coded by alphabetical position from 0.

    The tier list is one small array: Spark prunes its sub-query down to the
    customer table.
    """
    tiers = features.agg(F.array_sort(F.collect_set("customer_tier"))).scalar()
    code = F.array_position(tiers, F.col("customer_tier")) - 1
    return churn_ratios(features).select(
        "customer_id", as_number(code).alias(MODEL_COLUMNS[0]), *MODEL_COLUMNS[1:], "is_churned"
    )


def churn_dataset_summary(features: DataFrame) -> DataFrame:
    """One row: customers, churn rate, mean spend and mean orders."""
    rows = F.count("*")
    return features.agg(
        rows.alias("customers"),
        mean_of(F.sum("is_churned"), rows).alias("churn_rate"),
        mean_of(F.sum("total_spent"), rows).alias("avg_total_spent"),
        mean_of(F.sum("total_orders"), rows).alias("avg_total_orders"),
    )


def clv_by_tier(features: DataFrame) -> DataFrame:
    """Lifetime value, recency and recent orders per tier, best tier first."""
    rows = F.count("*")
    return (
        features.groupBy("customer_tier")
        .agg(
            rows.alias("customers"),
            mean_of(F.sum("total_spent"), rows).alias("avg_clv"),
            mean_of(F.sum("days_since_last_order"), rows).alias("avg_recency"),
            mean_of(F.sum("orders_last_90_days"), rows).alias("recent_activity"),
        )
        .orderBy(F.col("avg_clv").desc())
    )


def at_risk(features: DataFrame) -> DataFrame:
    """Repeat customers who have been silent for a while but not for too long."""
    silent = F.col("days_since_last_order")
    return features.filter(
        (silent > AT_RISK_AFTER_DAYS)
        & (silent < AT_RISK_BEFORE_DAYS)
        & (F.col("total_orders") > AT_RISK_MIN_ORDERS)
    )


def retention_alert_count(features: DataFrame) -> DataFrame:
    return at_risk(features).agg(F.count("*").alias("high_risk_customers"))
