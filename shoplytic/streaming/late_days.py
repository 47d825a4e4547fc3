"""Daily sales of a stream in any order: late rows mend the days already written.

Every micro-batch shrinks to partial sums per day and customer, written into a folder of
its own; those of days that the watermark has left behind go to a side table, so what came
late can be looked at and counted. Partial sums of both tables add up, so a day is written
anew from them whenever a batch touches it, and readers take the newest version of each day.
Days that no batch touches are not read. An entry in the ledger makes a batch count; a batch
that runs again replaces its own folders, so counts survive restarts.

A null ``order_ts`` is a day of its own (null). Customers that are null are not counted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shoplytic.session import pinned
from shoplytic.sources.ledger import Ledger
from shoplytic.streaming.insert_once import query_id
from shoplytic.streaming.sales_stream import daily_sales

PARTIAL = (
    "customer_id long, orders long, amounts long, amount decimal(28,2), load string, "
    "sales_date date"
)
DAY = (
    "sales_date date, order_count long, daily_revenue decimal(38,2), avg_order_value double, "
    "unique_customers long, load string"
)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks per core; Spark's default is a task per folder."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


class DaySales:
    """The tables in ``folder``: ``on_time``, ``late`` and ``days``."""

    def __init__(
        self, spark: SparkSession, folder: str, late_by: dt.timedelta = dt.timedelta(days=1)
    ) -> None:
        self.spark, self.folder, self.late_by = spark, folder, late_by
        self.ledger = Ledger(
            spark,
            f"{folder}/ledger",
            "load string, number long, newest timestamp, arrived long, late long",
        )

    def _committed(self, name: str, schema: str, also: str | None = None) -> DataFrame:
        # A row per batch, a few numbers each.
        loads = [e.load for e in self.ledger.entries().select("load").collect()]
        loads += [also] if also else []
        if not loads:
            return self.spark.createDataFrame([], schema)
        with few_listing_tasks(self.spark):
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows.filter(F.col("load").isin(loads))

    def partials(self, also: str | None = None) -> DataFrame:
        """Sums per day and customer of all committed batches, those of late rows too."""
        return self._committed("on_time", PARTIAL, also).unionByName(
            self._committed("late", PARTIAL, also)
        )

    def add(self, orders: DataFrame, load: str) -> None:
        """Commit a batch of orders (``order_ts, customer_id, total_amount``) as ``load``."""
        entries = self.ledger.entries()
        if not entries.filter(F.col("load") == load).isEmpty():
            return
        so_far = entries.agg(F.max("newest"), F.coalesce(F.max("number"), F.lit(-1))).first()
        partial = pinned(
            orders.groupBy(F.to_date("order_ts").alias("sales_date"), "customer_id").agg(
                F.count("*").alias("orders"),
                F.count("total_amount").alias("amounts"),
                F.sum("total_amount").cast("decimal(28,2)").alias("amount"),
                F.max("order_ts").alias("newest"),
            )
        )
        # As Spark's watermark: a day is over once its end is that far behind the newest.
        end = F.date_add("sales_date", 1).cast("timestamp")
        over = F.lit(False)
        if so_far[0] is not None:
            over = F.coalesce(end <= F.lit(so_far[0] - self.late_by), F.lit(False))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for name, part in (("on_time", partial.filter(~over)), ("late", partial.filter(over))):
            # A task gets some days, or a part of a large one; else every task writes all days.
            # With the number given, small batches keep their tasks: opening files takes longest.
            part.drop("newest").repartitionByRange(tasks, "sales_date", "customer_id").write.mode(
                "overwrite"
            ).partitionBy("sales_date").parquet(f"{self.folder}/{name}/load={load}")
        # At most one per day of the calendar.
        days = [r[0] for r in partial.select("sales_date").distinct().collect()]
        touched = F.col("sales_date").isin([d for d in days if d is not None])
        if None in days:
            touched = touched | F.col("sales_date").isNull()
        merged = (
            self.partials(also=load)
            .filter(touched)
            .groupBy("sales_date", "customer_id")
            .agg(*[F.sum(c).alias(c) for c in ("orders", "amounts", "amount")])
        )
        daily_sales(merged).write.mode("overwrite").parquet(f"{self.folder}/days/load={load}")
        counts = partial.agg(
            F.max("newest"), F.coalesce(F.sum("orders"), F.lit(0)),
            F.coalesce(F.sum(F.when(over, F.col("orders"))), F.lit(0)),
        ).first()
        newest = max((t for t in (so_far[0], counts[0]) if t is not None), default=None)
        self.ledger.add(load, so_far[1] + 1, newest, counts[1], counts[2])

    def days(self) -> DataFrame:
        """The newest version of every day."""
        numbers = F.broadcast(self.ledger.entries().select("load", "number"))
        versions = self._committed("days", DAY).join(numbers, "load")
        values = [c for c in versions.columns if c not in ("sales_date", "load", "number")]
        newest = F.max_by(F.struct(*values), "number").alias("newest")
        return versions.groupBy("sales_date").agg(newest).select("sales_date", "newest.*")

    def late_rows(self) -> int:
        """Orders that came after their day was over, since the tables began."""
        return self.ledger.entries().agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]


def day_sales_stream(stream: DataFrame, tables: DaySales, checkpoint: str) -> StreamingQuery:
    """Add everything available now to ``tables``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        tables.add(batch, f"{query_id(batch)}-{batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(add)
        .trigger(availableNow=True)
        .start()
    )


class DropCounter(StreamingQueryListener):
    """Counts the rows that state operators drop behind the watermark, for good.

    Register it with ``spark.streams.addListener``. Every batch that drops rows is an entry
    in ``folder``, so the count covers all batches and earlier sessions, where a query's
    ``recentProgress`` holds its last hundred only.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__()
        self.ledger = Ledger(spark, folder, "query string, batch long, dropped long")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        if dropped:
            self.ledger.add(str(progress.id), progress.batchId, dropped)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def dropped(self) -> int:
        """Rows dropped so far. A batch that ran again counts once."""
        again = Window.partitionBy("query", "batch").orderBy(F.desc("dropped"))
        once = self.ledger.entries().withColumn("run", F.row_number().over(again))
        return once.filter("run = 1").agg(F.coalesce(F.sum("dropped"), F.lit(0))).first()[0]
