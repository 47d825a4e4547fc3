"""The daily revenue forecast: gradient-boosted trees over ``sales_features``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.functions.dates import weekday_from_monday
from shoplytic.session import pinned

# Model inputs in their training order, and boosting settings.
FORECAST_COLUMNS = (
    "revenue_lag_1",
    "revenue_lag_7",
    "revenue_lag_14",
    "revenue_lag_30",
    "revenue_ma_7",
    "revenue_ma_30",
    "revenue_trend_7",
    "order_count",
    "avg_order_value",
    "unique_customers",
    "day_of_week",
    "month",
    "is_weekend",
    "is_month_start",
    "is_month_end",
)
TREES = 100
LEARNING_RATE = 0.1
MAX_DEPTH = 6
TRAIN_FRACTION = 0.8
SEED = 42

# Smallest actual value a percentage error is measured against.
_SMALLEST = 2.220446049250313e-16


def _numeric(features: DataFrame, *keep: str) -> DataFrame:
    inputs = [F.col(c).cast("double").alias(c) for c in FORECAST_COLUMNS]
    return features.select(*keep, *inputs)


def chronological_split(
    features: DataFrame, series: Sequence[str] = (), train_fraction: float = TRAIN_FRACTION
) -> DataFrame:
    """Add ``is_test``: the rows after the first ``int(train_fraction * n)`` days."""
    by_date = Window.partitionBy(*series).orderBy("sales_date")
    rows = F.count("*").over(Window.partitionBy(*series))
    return features.withColumn(
        "is_test", F.row_number().over(by_date) > F.floor(rows * train_fraction)
    )


def forecast_pipeline(seed: int = SEED, trees: int = TREES) -> Pipeline:
    inputs = VectorAssembler(inputCols=list(FORECAST_COLUMNS), outputCol="features")
    trees = GBTRegressor(
        labelCol="daily_revenue",
        maxIter=trees,
        stepSize=LEARNING_RATE,
        maxDepth=MAX_DEPTH,
        seed=seed,
    )
    return Pipeline(stages=[inputs, trees])


def train_forecast(
    features: DataFrame, series: Sequence[str] = (), seed: int = SEED, trees: int = TREES
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the first 80 % of days; metrics as one row per series.

    Percentage errors of both parts, and actual against predicted revenue of the
    newest day.
    """
    actual = F.col("daily_revenue").cast("double").alias("daily_revenue")
    split = _numeric(chronological_split(features, series), *series, "sales_date", "is_test", actual)
    # Each tree reads the days again: keep them in memory, and on shared storage
    # so that a lost executor does not mean reading the orders once more.
    split = pinned(split)
    kept = split.persist()
    try:
        model = forecast_pipeline(seed, trees).fit(kept.filter(~F.col("is_test")))
    finally:
        kept.unpersist()
    y, predicted = F.col("daily_revenue"), F.col("prediction")
    error = F.abs(y - predicted) / F.greatest(F.abs(y), F.lit(_SMALLEST))
    newest = F.when(F.col("is_test"), F.col("sales_date"))
    metrics = model.transform(split).groupBy(*series).agg(
        F.avg(F.when(~F.col("is_test"), error)).alias("train_mape"),
        F.avg(F.when(F.col("is_test"), error)).alias("test_mape"),
        F.max_by(y, newest).alias("last_actual"),
        F.max_by(predicted, newest).alias("last_predicted"),
    )
    return model, metrics


def sales_forecast(
    model: PipelineModel | None,
    features: DataFrame,
    days_ahead: int = 30,
    series: Sequence[str] = (),
) -> DataFrame:
    """Forecast every series ``days_ahead`` days from its newest row.

    Each step feeds its prediction back as yesterday's revenue and moves date,
    weekday (Monday = 0) and month; the other inputs stay as they were. The steps
    are chained expressions on one row per series: no shuffle after the seed rows.
    """
    if model is None:
        raise ValueError("train or load a forecast model first")
    newest = F.max_by(F.struct("sales_date", *FORECAST_COLUMNS), "sales_date").alias("newest")
    seeds = features.groupBy(*series).agg(newest).filter(F.col("newest").isNotNull())
    keep = [*series, "sales_date"]
    rows = _numeric(seeds.select(*series, "newest.*"), *keep)
    steps: list[str] = []
    for number in range(1, days_ahead + 1):
        step = f"_step_{number}"
        next_day = F.date_add("sales_date", 1)
        scored = model.transform(rows)
        rows = scored.select(
            *series,
            *steps,
            F.struct(
                next_day.alias("forecast_date"),
                F.col("prediction").alias("predicted_revenue"),
                F.lit(number).alias("day_number"),
            ).alias(step),
            next_day.alias("sales_date"),
            F.col("prediction").alias("revenue_lag_1"),
            weekday_from_monday(next_day).cast("double").alias("day_of_week"),
            F.month(next_day).cast("double").alias("month"),
            *[
                c
                for c in FORECAST_COLUMNS
                if c not in ("revenue_lag_1", "day_of_week", "month")
            ],
        )
        steps.append(step)
    return rows.select(*series, F.inline(F.array(*steps)))
