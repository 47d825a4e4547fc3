"""Registered streaming queries: a table read as a stream, run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.schema import MONEY
from shoplytic.session import checkpoint_folder
from shoplytic.sources import tpch
from shoplytic.streaming import insert_once, late_days, running, sales_stream

SCATTERED_FILES = 6


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Valid orders of the raw table as a stream, with their event time."""
    raw = sales_stream.order_stream(spark, folder, tpch.SCHEMAS["orders"], "orders.parquet")
    return _valid(raw)


def _valid(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("o_orderstatus").isin(*tpch.VALID)).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderdate").cast("timestamp").alias("order_ts"),
    )


def _staged(spark: SparkSession, orders: DataFrame, files_per_batch: int) -> DataFrame:
    """``orders`` written to a folder and read from it as a stream, so many files at a time."""
    path = f"{checkpoint_folder(spark)}/staged-{uuid.uuid4()}"
    orders.write.parquet(path)
    return sales_stream.order_stream(spark, path, orders.schema, files_per_batch=files_per_batch)


def _scattered(spark: SparkSession, folder: str) -> DataFrame:
    """Valid orders in batches by a hash of their number: each has orders of all days."""
    orders = _valid(tpch.table(spark, folder, "orders"))
    return _staged(spark, orders.repartition(SCATTERED_FILES, "order_id"), 1)


def _run(spark: SparkSession, stream: DataFrame, write) -> DataFrame:
    """What the stream wrote, with the ``batch_id`` of each row."""
    home = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"
    write(stream, f"{home}/out", f"{home}/state").awaitTermination()
    kinds = ", ".join(f"{name} {kind}" for name, kind in stream.dtypes)
    return spark.read.schema(f"{kinds}, batch_id long").parquet(f"{home}/out")


def _days(spark: SparkSession, folder: str) -> DataFrame:
    stream = sales_stream.day_customers(_orders(spark, folder))
    written = _run(spark, stream, sales_stream.update_stream)
    return sales_stream.newest_rows(written, "sales_date", "customer_id")


def stream_daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    return sales_stream.daily_sales(_days(spark, folder))


def stream_running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals so far, with the exact customers next to whether the estimate is near."""
    stream = sales_stream.running_totals(_orders(spark, folder))
    totals = sales_stream.latest(_run(spark, stream, sales_stream.complete_stream))
    exact = _days(spark, folder).agg(F.countDistinct("customer_id")).scalar()
    off = F.abs(F.col("active_customers_estimate") - exact)
    # Three standard errors of the estimate, 5 % each.
    return totals.select(
        "total_orders",
        "total_revenue",
        "avg_order_value",
        exact.alias("active_customers"),
        (off <= 0.15 * exact).alias("estimate_is_near"),
    )


def stream_first_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Every order arrives twice, from two readers of the table."""
    twice = _orders(spark, folder).union(_orders(spark, folder))
    loaded = _run(spark, sales_stream.first_arrivals(twice), sales_stream.append_stream)
    return loaded.select(
        "order_id", "customer_id", "total_amount", F.to_date("order_ts").alias("order_date")
    )


def stream_insert_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every order twice in one stream, and again 60 days later from a new checkpoint."""
    home = f"{checkpoint_folder(spark)}/insert-{uuid.uuid4()}"
    orders = _orders(spark, folder).drop("payment_method")
    late = orders.withColumn("order_ts", F.col("order_ts") + F.expr("INTERVAL 60 DAYS"))
    for number, arrivals in enumerate((orders.union(orders), late)):
        index = insert_once.ArrivedKeys(spark, f"{home}/index")
        insert_once.insert_stream(
            arrivals, index, f"{home}/out", f"{home}/state-{number}"
        ).awaitTermination()
    schema = ", ".join(f"{name} {kind}" for name, kind in orders.dtypes)
    return insert_once.loaded_rows(index, f"{home}/out", schema).select(
        "order_id", "customer_id", "total_amount", F.to_date("order_ts").alias("order_date")
    )


def stream_late_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sales when all but the first batch is late."""
    home = f"{checkpoint_folder(spark)}/days-{uuid.uuid4()}"
    tables = late_days.DaySales(spark, f"{home}/tables")
    late_days.day_sales_stream(
        _scattered(spark, folder), tables, f"{home}/state"
    ).awaitTermination()
    return tables.days()


def stream_exact_totals(spark: SparkSession, folder: str) -> DataFrame:
    buckets = running.customer_buckets(_scattered(spark, folder))
    written = _run(spark, buckets, sales_stream.update_stream)
    return running.exact_totals(sales_stream.newest_rows(written, "bucket"))


def _features(spark: SparkSession, folder: str, series: list[str]) -> DataFrame:
    """Features of closed days; an order without amount, far ahead, closes the last one."""
    orders = _valid(tpch.table(spark, folder, "orders"))
    nothing = {c: F.lit(None).cast(kind) for c, kind in orders.dtypes if c != "order_ts"}
    ahead = orders.agg((F.max("order_ts") + F.expr("INTERVAL 30 DAYS")).alias("order_ts"))
    closing = ahead.withColumns(nothing).filter("order_ts IS NOT NULL")
    stream = _staged(spark, orders.unionByName(closing.select(*orders.columns)), 1000)
    with running.stateful_session(spark):
        features = running.running_features(running.closed_days(stream, series), series)
        return _run(spark, features, sales_stream.append_stream).drop("batch_id")


def stream_sales_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, [])


def stream_sales_features_by_payment(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, ["payment_method"])
