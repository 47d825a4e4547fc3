"""Validation report: one row per rule with the number of rows that break it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytic.operators.pricing import line_total
from shoplytic.schema import Tables


def _row_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """All rules of one table in one pass; a null outcome is no violation."""
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return _as_rows(counts, **dict.fromkeys(rules, table))


def _order_reports(t: Tables) -> DataFrame:
    """Everything about orders and the lines that name them, in one join.

    Lines shrink to one row per order first. An order without lines and lines
    without an order both survive the full join.
    """
    lines = (
        t.order_items.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.count("*").alias("lines"), F.sum("line_total").alias("lines_total"))
    )
    expected_total = (
        F.col("subtotal") + F.col("tax_amount") + F.col("shipping_cost") - F.col("discount_amount")
    )
    known = t.orders.select(
        "order_id",
        "subtotal",
        (F.col("total_amount") != expected_total).alias("total_wrong"),
        (~F.col("order_status").isin(*t.statuses)).alias("status_wrong"),
        F.lit(True).alias("known"),
    )
    subtotal_wrong = F.col("subtotal") != F.coalesce("lines_total", F.lit(0))
    joined = known.join(lines, "order_id", "full").agg(
        F.count_if("total_wrong").alias("total_matches"),
        F.count_if("status_wrong").alias("status_known"),
        F.count_if(subtotal_wrong).alias("subtotal_matches"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("lines"))), F.lit(0)).alias(
            "order_exists"
        ),
    )
    return _as_rows(
        joined,
        total_matches="orders",
        status_known="orders",
        subtotal_matches="orders",
        order_exists="order_items",
    )


def _as_rows(counts: DataFrame, **tables: str) -> DataFrame:
    """One row of counts as rows of table, rule, violations."""
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(table).alias("table"),
                        F.lit(rule).alias("rule"),
                        F.col(rule).alias("violations"),
                    )
                    for rule, table in tables.items()
                ]
            )
        )
    )


def _orphans(
    child: DataFrame, table: str, key: str, parent: DataFrame, rule: str
) -> DataFrame:
    """Child rows without a parent. Keys are counted first, so a hot key is one row."""
    keys = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    missing = keys.join(parent.select(key), key, "left_anti")
    return missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations"
    )


def _primary_addresses(t: Tables) -> DataFrame:
    primary = (
        t.customer_addresses.filter(F.col("is_primary"))
        .groupBy("customer_id")
        .agg(F.count("*").alias("primaries"))
    )
    wrong = F.coalesce("primaries", F.lit(0)) != 1
    return (
        t.customers.join(primary, "customer_id", "left")
        .agg(F.count_if(wrong).alias("violations"))
        .select(
            F.lit("customer_addresses").alias("table"),
            F.lit("one_primary_address").alias("rule"),
            "violations",
        )
    )


def quality_report(t: Tables) -> DataFrame:
    """Amount identities, value domains, foreign keys and primary addresses."""
    priced = line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_applied"))
    line_rules = {
        "line_total_matches": F.col("line_total") != priced,
        "quantity_positive": F.col("quantity") <= 0,
    }
    tier_rule = {"tier_known": ~F.col("customer_tier").isin(*t.tiers)}
    reports = [
        _row_rules(t.order_items, "order_items", line_rules),
        _order_reports(t),
        _row_rules(t.customers, "customers", tier_rule),
        _orphans(t.orders, "orders", "customer_id", t.customers, "customer_exists"),
        _orphans(t.order_items, "order_items", "product_id", t.products, "product_exists"),
        _orphans(t.products, "products", "category_id", t.categories, "category_exists"),
        _orphans(
            t.customer_addresses,
            "customer_addresses",
            "customer_id",
            t.customers,
            "customer_exists",
        ),
        _primary_addresses(t),
    ]
    return functools.reduce(DataFrame.unionByName, reports)
