"""Exact running totals, and features of running series, from a stream of orders.

Totals. State holds one row per bucket of 32,768 customer ids: their orders and amounts, and
a bitmap of the customers seen, 4 KB. Bitmaps of a bucket merge by OR and those of different
buckets share no id, so the number of distinct customers is exact after every batch, in
state that is bounded by the range of ids and not by the orders. Ids should be dense, as an
order system's are: ids scattered over all longs would take a bucket each.

Features. Sales per day, once the watermark has closed the day, meet the last thirty days of
their series, which a state processor keeps in a ring, and come out with lags, trailing means
and growth at once. Both work on any number of series; a task holds one ring at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shoplytic.functions.dates import weekday_from_sunday
from shoplytic.functions.numeric import mean_of
from shoplytic.operators.sales import (
    LAGS,
    MONTH_END_FROM,
    MONTH_START_TO,
    TRAILING_MEANS,
    WEEKEND,
)

# The state processor travels to the executors as it is, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def customer_buckets(orders: DataFrame) -> DataFrame:
    """Sums and a bitmap of customers per bucket of ids; for update mode.

    Customers that are null share a bucket (null) without a bit.
    """
    return orders.groupBy(F.bitmap_bucket_number("customer_id").alias("bucket")).agg(
        F.count("*").alias("orders"),
        F.count("total_amount").alias("amounts"),
        F.sum("total_amount").alias("amount"),
        F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("customers"),
    )


def merged_buckets(buckets: DataFrame) -> DataFrame:
    """One row per bucket from the rows of several streams or periods."""
    return buckets.groupBy("bucket").agg(
        *[F.sum(c).alias(c) for c in ("orders", "amounts", "amount")],
        F.bitmap_or_agg("customers").alias("customers"),
    )


def exact_totals(buckets: DataFrame) -> DataFrame:
    """Order count, revenue, mean value and exact distinct customers; one row per bucket in."""
    totals = buckets.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.sum("amount").alias("total_revenue"),
        F.sum("amounts").alias("_amounts"),
        F.coalesce(F.sum(F.bitmap_count("customers")), F.lit(0)).alias("active_customers"),
    )
    return totals.select(
        "total_orders",
        "total_revenue",
        mean_of(F.col("total_revenue"), F.col("_amounts")).alias("avg_order_value"),
        "active_customers",
    )


def closed_days(
    orders: DataFrame, series: Sequence[str] = (), late_by: str = "1 day"
) -> DataFrame:
    """Sales per day and series, each once, when the watermark has passed the day's end.

    Customers are counted exactly, by a first sum per day and customer.
    """
    per_customer = (
        orders.withWatermark("order_ts", late_by)
        .groupBy(F.window("order_ts", "1 day").alias("day"), *series, "customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.count("total_amount").alias("amounts"),
            F.sum("total_amount").alias("amount"),
        )
    )
    days = per_customer.groupBy(F.window(F.window_time("day"), "1 day").alias("day"), *series).agg(
        F.sum("orders").alias("order_count"),
        F.sum("amount").alias("daily_revenue"),
        F.sum("amounts").alias("amounts"),
        F.count("customer_id").alias("unique_customers"),
    )
    return days.select(
        *series,
        F.to_date("day.start").alias("sales_date"),
        "order_count",
        "daily_revenue",
        mean_of(F.col("daily_revenue"), F.col("amounts")).alias("avg_order_value"),
        "unique_customers",
    )


class SeriesRing(StatefulProcessor):
    """Keeps the newest revenues of a series and gives each new day what came before it."""

    def __init__(self, columns: Sequence[str]) -> None:
        """``columns`` of the rows to give: key, day, lags and means."""
        self.columns, self.kept = tuple(columns), max(LAGS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "revenues array<decimal(38,2)>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made = Row(*self.columns)
        ring = list(self.ring.get()[0]) if self.ring.exists() else []
        # A batch holds few days of a series, and none before those of earlier batches.
        for row in sorted(rows, key=lambda r: r.sales_date):
            revenue = row.daily_revenue
            means = []
            for length in TRAILING_MEANS:
                window = [*ring, revenue][-length:]
                whole = len(window) == length and None not in window
                means.append(float(sum(window)) / length if whole else None)
            lags = [ring[-lag] if lag <= len(ring) else None for lag in LAGS]
            yield made(*key, *[row[c] for c in DAY_COLUMNS], *lags, *means)
            ring = [*ring, revenue][-self.kept :]
        self.ring.update((ring,))

    def close(self) -> None:
        pass


DAY_COLUMNS = ("sales_date", "order_count", "daily_revenue", "avg_order_value", "unique_customers")


def running_features(days: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """The columns of ``sales_features`` for every closed day that has thirty days before it.

    ``days`` is what ``closed_days`` gives. Needs the state store of ``stateful_session``.
    """
    kinds = {f.name: f.dataType for f in days.schema.fields}
    if not series:
        days = days.withColumn("_series", F.lit(0))
        kinds["_series"] = T.IntegerType()
    key = list(series) or ["_series"]
    money = T.DecimalType(38, 2)
    kinds["daily_revenue"] = money
    days = days.withColumn("daily_revenue", F.col("daily_revenue").cast(money))
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in (*key, *DAY_COLUMNS)]
        + [T.StructField(f"revenue_lag_{n}", money) for n in LAGS]
        + [T.StructField(f"revenue_ma_{n}", T.DoubleType()) for n in TRAILING_MEANS]
    )
    found = days.groupBy(*key).transformWithState(
        SeriesRing(schema.names), schema, "Append", "None"
    )
    date, revenue = F.col("sales_date"), F.col("daily_revenue").cast("double")
    day_of_month = F.dayofmonth(date)

    def ratio_to(column: str):
        bottom = F.col(column).cast("double")
        return revenue / F.when(bottom != 0, bottom)

    return (
        found.withColumn("day_of_week", weekday_from_sunday(date))
        .withColumn("month", F.month(date))
        .withColumn("revenue_growth", ratio_to("revenue_lag_1") - 1)
        .withColumn("is_weekend", F.col("day_of_week").isin(*WEEKEND).cast("int"))
        .withColumn("is_month_start", (day_of_month <= MONTH_START_TO).cast("int"))
        .withColumn("is_month_end", (day_of_month >= MONTH_END_FROM).cast("int"))
        .withColumn("revenue_trend_7", ratio_to("revenue_ma_7"))
        .drop("_series")
        .dropna()
    )


@contextmanager
def stateful_session(spark: SparkSession):
    """The state store that state processors need, for queries started inside the block."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS_DB)
    try:
        yield spark
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
