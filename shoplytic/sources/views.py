"""The shop's feature views, as temporary views or as written tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.operators.affinity import product_affinity
from shoplytic.operators.churn import churn_features
from shoplytic.operators.sales import daily_sales, sales_features
from shoplytic.schema import Tables


def customer_ml_features(t: Tables, as_of: dt.date, grain: str = "order") -> DataFrame:
    return churn_features(t, as_of, grain=grain)


def daily_sales_features(t: Tables) -> DataFrame:
    return sales_features(daily_sales(t))


def register_views(t: Tables, as_of: dt.date) -> None:
    """Name the feature views for SQL; each is computed when a query reads it."""
    customer_ml_features(t, as_of).createOrReplaceTempView("customer_ml_features")
    daily_sales_features(t).createOrReplaceTempView("daily_sales_features")


def publish_daily_sales(t: Tables, path: str) -> None:
    """Write the daily features, partitioned by year for pruning."""
    features = daily_sales_features(t).withColumn("sales_year", F.year("sales_date"))
    features.write.mode("overwrite").partitionBy("sales_year").parquet(path)


def publish_affinity(t: Tables, path: str, min_pair_orders: int = 2) -> None:
    product_affinity(t, min_pair_orders).write.mode("overwrite").parquet(path)
