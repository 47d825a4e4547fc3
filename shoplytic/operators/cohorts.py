"""Retention of customers by the month of their first order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.functions.dates import month_start, whole_months
from shoplytic.functions.numeric import share_pct
from shoplytic.schema import Tables, valid_orders
from shoplytic.session import pinned


def cohort_retention(t: Tables) -> DataFrame:
    """Active customers and retention rate per cohort month and months since.

    Orders shrink to one row per customer and month before the window, so a
    customer's window holds at most as many rows as there are months.
    """
    active = (
        valid_orders(t)
        .select("customer_id", month_start(F.col("order_date")).alias("activity_month"))
        .distinct()
    )
    first = F.min("activity_month").over(Window.partitionBy("customer_id"))
    counts = (
        active.select("activity_month", first.alias("cohort_month"))
        .groupBy(
            "cohort_month",
            whole_months(F.col("activity_month"), F.col("cohort_month")).alias("period_number"),
        )
        .agg(F.count("*").alias("active_customers"))
    )
    from_start = (
        Window.partitionBy("cohort_month")
        .orderBy("period_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cohort_size = F.first("active_customers").over(from_start)
    return counts.select(
        "cohort_month",
        "period_number",
        "active_customers",
        share_pct(F.col("active_customers"), cohort_size, 1).alias("retention_rate"),
    ).orderBy("cohort_month", "period_number")


def cohort_matrix(retention: DataFrame, max_period: int | None = None) -> DataFrame:
    """One row per cohort and a retention column per period 0..``max_period``.

    Without a number the matrix is as wide as the data: finding the last period is a
    Spark job of its own, as columns must be known before the query runs.
    """
    if max_period is None:
        retention = pinned(retention)  # a row per cohort and period, read twice
        max_period = retention.agg(F.max("period_number")).first()[0] or 0
    periods = list(range(max_period + 1))
    wide = retention.groupBy("cohort_month").pivot("period_number", periods)
    cells = wide.agg(F.first("retention_rate"))
    return cells.select(
        "cohort_month", *[F.col(str(p)).alias(f"period_{p}") for p in periods]
    ).orderBy("cohort_month")


def last_period(t: Tables) -> int:
    """Months between the first and the last valid order: the widest matrix."""
    dates = valid_orders(t).agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last")
    )
    span = whole_months(F.col("last"), F.col("first"))
    return dates.select(F.coalesce(span, F.lit(0)).alias("months")).first()["months"]
