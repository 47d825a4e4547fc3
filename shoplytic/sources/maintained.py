"""The shop's feature views, kept up to date by the periods that changed.

A view is stored as partial sums: per order date and customer, and the products that a
customer bought per period. They lie by period (day or month) and by the version that wrote
them. A publish looks at the files of each period's orders and lines, computes the periods
whose files changed since the last version, and then commits a manifest that names, for
every period, the version to read. So a new day costs one day of orders; readers see a whole
version or the one before; a publish that fails is never seen.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.functions.dates import day, days_before, weekday_from_sunday
from shoplytic.functions.numeric import mean_of
from shoplytic.operators.churn import ACTIVE_DAYS, assembled_features
from shoplytic.operators.products import sold_items
from shoplytic.operators.sales import sales_features
from shoplytic.schema import Tables, valid_orders
from shoplytic.sources.ledger import Ledger

MONEY = "decimal(28,2)"


@dataclass(frozen=True)
class Published:
    """The version readers get from now on, and the periods that were computed for it."""

    version: int
    periods: tuple[dt.date, ...]


def _files_by_period(frame: DataFrame, by: str) -> dict[dt.date, list[str]]:
    """The files of each period's folder. A folder that is written again has other files."""
    found: dict[dt.date, list[str]] = {}
    for file in frame.inputFiles():
        folder = re.search(rf"{by}=(\d{{4}}-\d{{2}}-\d{{2}})/", file)
        if folder:
            found.setdefault(dt.date.fromisoformat(folder[1]), []).append(file)
    return found


def _fingerprint(files: list[str]) -> int:
    text = "\n".join(sorted(files)).encode()
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True)


class FeatureViews:
    """The views under ``root``; ``by`` is the layout's period column.

    ``t.orders`` and ``t.order_items`` of the methods are read from a layout by that period
    (``layout.read_rows``).
    """

    def __init__(self, spark: SparkSession, root: str, by: str) -> None:
        self.spark, self.root, self.by = spark, root, by
        self.manifests = Ledger(
            spark, f"{root}/manifests", f"version long, {by} date, files long, data long"
        )

    def _newest(self) -> DataFrame:
        """The newest manifest: a row per period."""
        entries = self.manifests.entries()
        newest = entries.agg(F.max("version")).first()[0]
        return entries.filter(F.col("version") == (-1 if newest is None else newest))

    def publish(self, t: Tables) -> Published:
        """Compute what changed and commit it; without a change, the version stays."""
        orders, lines = (_files_by_period(f, self.by) for f in (t.orders, t.order_items))
        now = {p: _fingerprint(files + lines.get(p, [])) for p, files in orders.items()}
        entries = self._newest().collect()  # a row per period of the calendar
        before = {e[self.by]: e for e in entries}
        changed = sorted(p for p, f in now.items() if p not in before or before[p].files != f)
        version = max((e.version for e in entries), default=-1)
        if not changed and set(now) == set(before):
            return Published(version, ())
        version += 1
        if changed:
            self._write(self.part_of(t, changed), version)
        manifest = [
            (version, p, f, version if p in changed else before[p].data)
            for p, f in sorted(now.items())
        ]
        self.manifests.add_all(self.spark.createDataFrame(manifest, self.manifests.schema))
        return Published(version, tuple(changed))

    def part_of(self, t: Tables, periods: list[dt.date]) -> Tables:
        """The tables with the orders and lines of ``periods`` only."""
        some = F.col(self.by).isin(periods)
        return Tables(
            orders=t.orders.filter(some),
            order_items=t.order_items.filter(some).drop(self.by),
            valid_statuses=t.valid_statuses,
        )

    def _write(self, t: Tables, version: int) -> None:
        discounted = F.col("discount_amount") > 0
        customers = valid_orders(t).groupBy(self.by, "order_date", "customer_id").agg(
            F.count("*").alias("orders"),
            F.count("total_amount").alias("amounts"),
            F.sum("total_amount").cast(MONEY).alias("amount"),
            F.collect_set("payment_method").alias("payment_methods"),
            F.sum(F.when(discounted, 1).otherwise(0)).alias("discounts"),
            F.sum(F.when(discounted, F.col("discount_amount"))).alias("discount"),
        )
        products = sold_items(t, self.by, "customer_id").select(
            self.by, "customer_id", "product_id"
        )
        for name, rows in (("customers", customers), ("products", products.distinct())):
            rows.write.mode("overwrite").partitionBy(self.by).parquet(f"{self.root}/{name}/version={version}")

    def _current(self, name: str, schema: str) -> DataFrame:
        """The rows of a table that the newest manifest names."""
        manifest = self._newest().select(F.col("data").alias("version"), self.by)
        versions = [r[0] for r in manifest.select("version").distinct().collect()]
        if not versions:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version long, {self.by} date").parquet(
            f"{self.root}/{name}"
        )
        rows = rows.filter(F.col("version").isin(versions))
        return rows.join(F.broadcast(manifest), ["version", self.by], "left_semi")

    def customer_days(self) -> DataFrame:
        """Sums per order date and customer."""
        return self._current(
            "customers",
            "order_date date, customer_id long, orders long, amounts long, amount decimal(28,2), "
            "payment_methods array<string>, discounts long, discount decimal(38,4)",
        )

    def daily_features(self) -> DataFrame:
        """As ``sales_features`` over all orders."""
        date = F.col("sales_date")
        days = (
            self.customer_days()
            .groupBy(F.col("order_date").alias("sales_date"))
            .agg(
                F.sum("orders").alias("order_count"),
                F.sum("amount").alias("daily_revenue"),
                F.sum("amounts").alias("amounts"),
                F.count("customer_id").alias("unique_customers"),
            )
            .select(
                "sales_date",
                "order_count",
                "daily_revenue",
                mean_of(F.col("daily_revenue"), F.col("amounts")).alias("avg_order_value"),
                "unique_customers",
                weekday_from_sunday(date).alias("day_of_week"),
                F.month(date).alias("month"),
            )
        )
        return sales_features(days)

    def customer_features(self, customers: DataFrame, as_of: dt.date) -> DataFrame:
        """As ``churn_features`` at order grain over all orders."""
        recent = F.col("order_date") >= day(days_before(as_of, ACTIVE_DAYS))
        sums = self.customer_days().groupBy("customer_id").agg(
            F.sum("orders").alias("total_orders"),
            F.sum("amount").alias("total_spent"),
            F.sum("amounts").alias("amounts"),
            F.max("order_date").alias("last_valid_order"),
            F.sum(F.when(recent, F.col("orders"))).alias("orders_last_90_days"),
            F.sum(F.when(recent, F.col("amount"))).alias("spent_last_90_days"),
            F.size(F.array_distinct(F.flatten(F.collect_set("payment_methods"))))
            .cast("long")
            .alias("payment_methods_used"),
            F.sum("discounts").alias("discount_orders"),
            F.sum("discount").alias("discount_sum"),
        )
        products = self._current("products", "customer_id long, product_id long")
        counts = products.groupBy("customer_id").agg(
            F.countDistinct("product_id").alias("unique_products")
        )
        return assembled_features(customers, sums, counts, as_of)
