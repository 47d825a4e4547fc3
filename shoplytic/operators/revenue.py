"""Monthly revenue: totals, running totals, growth, linear trend.

Windows here run over one row per month, a number the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.functions.dates import month_start
from shoplytic.functions.numeric import growth_pct
from shoplytic.schema import Tables, valid_orders

# Growth beyond these percentages is called strong or a decline.
STRONG_GROWTH_PCT = 10
DECLINE_PCT = -10

MIN_MONTHS_FOR_TREND = 3


def monthly_revenue(orders: DataFrame) -> DataFrame:
    return orders.groupBy(month_start(F.col("order_date")).alias("month")).agg(
        F.count("*").alias("orders_count"),
        F.sum("total_amount").alias("monthly_revenue"),
    )


def revenue_trend(t: Tables) -> DataFrame:
    """Months with running total, previous month and month-over-month growth."""
    by_month = Window.orderBy("month")
    previous = F.lag("monthly_revenue").over(by_month)
    return (
        monthly_revenue(valid_orders(t))
        .select(
            "month",
            "orders_count",
            F.round("monthly_revenue", 2).alias("monthly_revenue"),
            F.sum("monthly_revenue").over(by_month).alias("cumulative_revenue"),
            previous.alias("prev_month_revenue"),
            growth_pct(F.col("monthly_revenue"), previous).alias("mom_growth_pct"),
        )
        .orderBy("month")
    )


def revenue_status(trend: DataFrame) -> DataFrame:
    """The newest month of ``revenue_trend`` with its growth in words."""
    growth = F.col("mom_growth_pct")
    status = (
        F.when(growth > STRONG_GROWTH_PCT, "Strong growth")
        .when(growth < DECLINE_PCT, "Revenue decline")
        .when(growth.isNotNull(), "Stable growth")
    )
    return (
        trend.orderBy(F.col("month").desc())
        .limit(1)
        .select("month", "monthly_revenue", "mom_growth_pct", status.alias("status"),
                "cumulative_revenue")
    )


def revenue_linear_trend(monthly: DataFrame) -> DataFrame:
    """Least-squares line through the months; no rows below three months."""
    every = Window.partitionBy()
    y = F.col("monthly_revenue").cast("double")
    x = F.col("day_offset")
    return (
        monthly.select(
            "month",
            F.datediff("month", F.min("month").over(every)).alias("day_offset"),
            y.alias("monthly_revenue"),
        )
        .select(
            "*",
            F.regr_slope(F.col("monthly_revenue"), x).over(every).alias("slope"),
            F.regr_intercept(F.col("monthly_revenue"), x).over(every).alias("intercept"),
            F.regr_r2(F.col("monthly_revenue"), x).over(every).alias("r_squared"),
            F.count("*").over(every).alias("_months"),
        )
        .filter(F.col("_months") >= MIN_MONTHS_FOR_TREND)
        .select(
            "month",
            "day_offset",
            "monthly_revenue",
            (F.col("slope") * x + F.col("intercept")).alias("trend_revenue"),
            "slope",
            "intercept",
            "r_squared",
        )
    )


def revenue_linear_forecast(monthly: DataFrame, periods: int = 3) -> DataFrame:
    """The trend line at the next ``periods`` month ends.

    The first is the earliest month end at least 30 days after the last month's
    start, which for a 31-day month is that month's own end.
    """
    ends = F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))
    first_end = F.last_day(F.date_add("last_month", 30))
    return (
        revenue_linear_trend(monthly)
        .agg(
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
            F.first("slope").alias("slope"),
            F.first("intercept").alias("intercept"),
        )
        .filter(F.col("last_month").isNotNull())
        .select("*", ends.alias("step"))
        .withColumn("forecast_date", F.last_day(F.add_months(first_end, F.col("step"))))
        .select(
            "forecast_date",
            (
                F.col("slope") * F.datediff("forecast_date", "first_month") + F.col("intercept")
            ).alias("predicted_revenue"),
        )
    )
