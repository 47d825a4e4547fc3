"""Rule-based business insights as rows of type, title, message and action."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplytic.functions.dates import day
from shoplytic.functions.numeric import ratio
from shoplytic.operators.churn import churn_features, retention_alert_count
from shoplytic.operators.revenue import DECLINE_PCT, STRONG_GROWTH_PCT, monthly_revenue
from shoplytic.schema import Tables, valid_orders
from shoplytic.sources.layout import in_dates

# Insight texts.
RETENTION = {
    "type": "warning",
    "title": "Customer Retention Alert",
    "message": "%d customers haven't ordered in 90+ days and may be at risk of churning.",
    "action": "Consider targeted re-engagement campaigns.",
}
GROWTH = {
    "type": "success",
    "title": "Strong Growth Detected",
    "message": "Revenue increased by %.1f%% last month - excellent momentum!",
    "action": "Consider scaling successful marketing channels.",
}
DECLINE = {
    "type": "warning",
    "title": "Revenue Decline Alert",
    "message": "Revenue decreased by %.1f%% last month.",
    "action": "Investigate causes and implement recovery strategies.",
}
NO_DATA = {
    "type": "info",
    "title": "ML Analysis",
    "message": "Advanced AI insights will be available after model training.",
    "action": "Train ML models for deeper analysis.",
}

TRAILING_MONTHS = 3


def _record(text: dict[str, str], *values: Column) -> list[Column]:
    message = F.format_string(text["message"], *values) if values else F.lit(text["message"])
    return [
        F.lit(text["type"]).alias("type"),
        F.lit(text["title"]).alias("title"),
        message.alias("message"),
        F.lit(text["action"]).alias("action"),
    ]


def retention_insight(features: DataFrame) -> DataFrame:
    count = F.col("high_risk_customers")
    return retention_alert_count(features).filter(count > 0).select(*_record(RETENTION, count))


def recent_monthly_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    """Months of the trailing quarter, counted back from ``as_of`` by date."""
    since = F.add_months(day(as_of), -TRAILING_MONTHS)
    return monthly_revenue(in_dates(valid_orders(t), since))


def revenue_trend_signal(t: Tables, as_of: dt.date) -> DataFrame:
    """The last two months of the trailing quarter and the growth between them.

    No row unless two months have sales. The newest month is usually still
    running; it is compared as it stands.
    """
    months = recent_monthly_revenue(t, as_of)
    by_month = Window.orderBy("month")
    latest, previous = F.col("monthly_revenue"), F.col("previous_revenue")
    growth = F.col("growth_rate")
    return (
        months.select(
            "month", "monthly_revenue", F.lag(latest).over(by_month).alias("previous_revenue")
        )
        .orderBy(F.col("month").desc())
        .limit(1)
        .filter(previous.isNotNull())
        .withColumn("growth_rate", ratio(latest - previous, previous) * 100)
        .withColumn(
            "signal",
            F.when(growth > STRONG_GROWTH_PCT, "growth").when(growth < DECLINE_PCT, "decline"),
        )
    )


def revenue_insight(signal: DataFrame) -> DataFrame:
    growth = F.col("growth_rate")
    up = signal.filter(F.col("signal") == "growth").select(*_record(GROWTH, growth))
    down = signal.filter(F.col("signal") == "decline").select(*_record(DECLINE, F.abs(growth)))
    return up.unionByName(down)


def no_data_insight(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*_record(NO_DATA))


def business_insights(
    t: Tables, as_of: dt.date, features: DataFrame | None = None, grain: str = "order"
) -> DataFrame:
    """All insights that apply. Without the needed tables, one record says so."""
    needed = (t.customers, t.orders, t.order_items)
    if any(frame is None for frame in needed):
        return no_data_insight(SparkSession.active())
    if features is None:
        features = churn_features(t, as_of, grain=grain)
    return retention_insight(features).unionByName(
        revenue_insight(revenue_trend_signal(t, as_of))
    )
