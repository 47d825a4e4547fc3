"""Daily sales series and its forecasting features.

A series has one row per day with sales, so windows over it are bounded by the
calendar. ``series`` names order columns that split sales into several series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.functions.dates import weekday_from_sunday
from shoplytic.functions.numeric import mean_of, ratio
from shoplytic.schema import Tables, valid_orders

# Lags and trailing means in rows, calendar flags in days of month.
LAGS = (1, 7, 14, 30)
TRAILING_MEANS = (7, 30)
MONTH_START_TO = 5
MONTH_END_FROM = 25
WEEKEND = (0, 6)


def daily_sales(t: Tables, series: Sequence[str] = ()) -> DataFrame:
    """Orders, revenue, mean order value and distinct customers per day."""
    day = F.col("sales_date")
    daily = (
        valid_orders(t)
        .groupBy(*series, F.to_date("order_date").alias("sales_date"))
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_amount").alias("daily_revenue"),
            F.count("total_amount").alias("_priced"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )
    return daily.select(
        *series,
        "sales_date",
        "order_count",
        "daily_revenue",
        mean_of(F.col("daily_revenue"), F.col("_priced")).alias("avg_order_value"),
        "unique_customers",
        weekday_from_sunday(day).alias("day_of_week"),
        F.month(day).alias("month"),
    ).orderBy(*series, "sales_date")


def sales_features(
    daily: DataFrame, series: Sequence[str] = (), lagged: bool = False
) -> DataFrame:
    """Lags, trailing means, trend, growth and calendar flags; incomplete rows go.

    The 7-row mean and the trend include the current day, so together they
    contain its revenue. ``lagged=True`` takes both from the row before.
    """
    by_date = Window.partitionBy(*series).orderBy("sales_date")
    revenue = F.col("daily_revenue")

    def trailing_mean(rows: int):
        window = by_date.rowsBetween(1 - rows, 0)
        total = mean_of(F.sum(revenue).over(window), F.lit(rows))
        return F.when(F.count(revenue).over(window) == rows, total)

    weekday, date = F.col("day_of_week"), F.col("sales_date")
    day_of_month = F.dayofmonth(date)
    features = daily.select(
        "*",
        *[F.lag(revenue, k).over(by_date).alias(f"revenue_lag_{k}") for k in LAGS],
        *[trailing_mean(k).alias(f"revenue_ma_{k}") for k in TRAILING_MEANS],
        (ratio(revenue, F.lag(revenue, 1).over(by_date)) - 1).alias("revenue_growth"),
        weekday.isin(*WEEKEND).cast("int").alias("is_weekend"),
        (day_of_month <= MONTH_START_TO).cast("int").alias("is_month_start"),
        (day_of_month >= MONTH_END_FROM).cast("int").alias("is_month_end"),
    ).withColumn("revenue_trend_7", ratio(revenue, F.col("revenue_ma_7")))
    if lagged:
        for column in ("revenue_ma_7", "revenue_trend_7"):
            features = features.withColumn(column, F.lag(column, 1).over(by_date))
    return features.dropna()
