"""Headline numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.functions.labels import money_text
from shoplytic.functions.numeric import mean_of
from shoplytic.schema import Tables, valid_orders


def active_products(t: Tables) -> DataFrame:
    return t.products.filter(F.col("is_active"))


def kpi_summary(t: Tables, zero_when_empty: bool = True) -> DataFrame:
    """One row of six KPIs: one aggregate per table, none of them joined.

    Without any valid order, revenue and average are 0, or null on request.
    """
    orders = valid_orders(t).agg(
        F.count("*").alias("total_orders"),
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("amounts"),
        F.countDistinct("customer_id").alias("active_customers"),
    )
    revenue = F.col("revenue")
    average = mean_of(revenue, F.col("amounts"))
    if zero_when_empty:
        revenue = F.coalesce(revenue, F.lit(0).cast("decimal(28,2)"))
        average = F.coalesce(average, F.lit(0.0))
    return orders.select(
        t.customers.agg(F.count("*")).scalar().alias("total_customers"),
        "total_orders",
        active_products(t).agg(F.count("*")).scalar().alias("active_products"),
        revenue.alias("total_revenue"),
        average.alias("avg_order_value"),
        "active_customers",
    )


def kpi_texts(t: Tables) -> DataFrame:
    """The KPIs as ``label, text`` rows with thousands separators."""

    def whole(column: str):
        return F.format_number(column, 0)

    texts = {
        "Total Customers": whole("total_customers"),
        "Total Orders": whole("total_orders"),
        "Active Products": whole("active_products"),
        "Total Revenue": money_text(F.col("total_revenue")),
        "Avg Order Value": money_text(F.col("avg_order_value")),
        "Active Customers": whole("active_customers"),
    }
    pairs = [
        F.struct(F.lit(label).alias("label"), text.alias("text"))
        for label, text in texts.items()
    ]
    return kpi_summary(t).select(F.inline(F.array(*pairs)))
