"""Daily sales, running totals and loading of orders from a stream.

The input of each function is a streaming frame with the columns of the orders
table and an event time ``order_ts``. State lives in the checkpoint each query
gets, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoplytic.functions.numeric import mean_of


def order_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    files: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """New files of ``folder`` as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def day_customers(orders: DataFrame, late_by: str = "1 day") -> DataFrame:
    """One state row per day and customer; for update mode.

    A row comes out whenever it changed, so the newest day is there at once and a
    busy customer's orders are partial sums. Orders later than ``late_by`` behind
    the newest are dropped and counted (``late_days.DropCounter``); ``late_days.DaySales``
    keeps them.
    """
    return (
        orders.withWatermark("order_ts", late_by)
        .groupBy(F.window("order_ts", "1 day").alias("day"), "customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.count("total_amount").alias("amounts"),
            F.sum("total_amount").alias("amount"),
        )
        .select(
            F.to_date("day.start").alias("sales_date"), "customer_id", "orders", "amounts", "amount"
        )
    )


def newest_rows(written: DataFrame, *key: str) -> DataFrame:
    """Of the batches that an update-mode stream wrote, the last row of every key."""
    values = [c for c in written.columns if c not in (*key, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("newest")
    return written.groupBy(*key).agg(newest).select(*key, "newest.*")


def daily_sales(days: DataFrame) -> DataFrame:
    """Orders, revenue, mean value and exact distinct customers per day.

    ``days`` has one row per day and customer, so distinct customers are a plain
    count; customers that are null are not counted.
    """
    return (
        days.groupBy("sales_date")
        .agg(
            F.sum("orders").alias("order_count"),
            F.sum("amount").alias("daily_revenue"),
            F.sum("amounts").alias("_amounts"),
            F.count("customer_id").alias("unique_customers"),
        )
        .select(
            "sales_date",
            "order_count",
            "daily_revenue",
            mean_of(F.col("daily_revenue"), F.col("_amounts")).alias("avg_order_value"),
            "unique_customers",
        )
    )


def running_totals(orders: DataFrame) -> DataFrame:
    """Order count, revenue and mean value so far; for complete mode.

    Distinct customers are estimated; ``running.exact_totals`` counts them exactly.
    """
    totals = orders.groupBy().agg(
        F.count("*").alias("total_orders"),
        F.sum("total_amount").alias("total_revenue"),
        F.count("total_amount").alias("_amounts"),
        F.approx_count_distinct("customer_id").alias("active_customers_estimate"),
    )
    return totals.select(
        "total_orders",
        "total_revenue",
        mean_of(F.col("total_revenue"), F.col("_amounts")).alias("avg_order_value"),
        "active_customers_estimate",
    )


def first_arrivals(
    orders: DataFrame, key: Sequence[str] = ("order_id",), late_by: str = "1 day"
) -> DataFrame:
    """The stream without repeated keys that arrive within the watermark.

    ``insert_once.insert_stream`` drops repeats however late they come.
    """
    return orders.withWatermark("order_ts", late_by).dropDuplicatesWithinWatermark(list(key))


def _write_batch(target: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch owns its folder, so running it again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def _load(stream: DataFrame, mode: str, target: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_write_batch(target))
        .trigger(availableNow=True)
        .start()
    )


def append_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Load everything available now; each batch is written exactly once."""
    return _load(stream, "append", target, checkpoint)


def update_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that each batch changed; ``newest_rows`` reads them back."""
    return _load(stream, "update", target, checkpoint)


def complete_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the whole result of each batch beside the earlier ones.

    Nothing is overwritten that a reader may be at; ``latest`` picks the newest.
    """
    return _load(stream, "complete", target, checkpoint)


def latest(written: DataFrame) -> DataFrame:
    """The rows of the newest batch of a complete-mode stream."""
    newest = written.agg(F.max("batch_id")).scalar()
    return written.filter(F.col("batch_id") == newest).drop("batch_id")


def late_rows(query: StreamingQuery) -> int:
    """Rows that state operators dropped as later than the watermark, in this run.

    Spark keeps the last hundred progress reports of a query; ``late_days.DropCounter``
    counts over all batches and runs.
    """
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )
