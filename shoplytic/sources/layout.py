"""Orders and lines laid out by time, so that date and tier filters read their folders only.

By month, a folder holds one month and customer tier, its rows sorted by customer, so a
reader of few customers skips row groups too. By day, a folder holds one day. The tier is
that at the time of writing; write the layout anew after customers have moved between tiers.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplytic.functions.dates import day, month_start
from shoplytic.operators.key_filter import key_filter, maybe_among
from shoplytic.schema import Tables
from shoplytic.session import pinned

MONTH, DAY, TIER = "order_month", "order_day", "order_tier"


def _period(by: str) -> Column:
    if by not in (MONTH, DAY):
        raise ValueError(f"lay out by {MONTH} or {DAY}, not {by!r}")
    date = F.to_date("order_date")
    return month_start(date) if by == MONTH else date


def _write(rows: DataFrame, path: str, folders: Sequence[str], order: str, mode: str) -> None:
    # Folders of many rows are split into files of the advised size, small ones share a task.
    rows.hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(
        *folders, order
    ).write.mode(mode).partitionBy(*folders).parquet(path)


def write_orders(t: Tables, path: str, by: str = MONTH, mode: str = "errorifexists") -> None:
    """Write ``t.orders`` in folders of ``by``, those of a month split by tier."""
    rows = t.orders.withColumn(by, _period(by))
    if by == DAY:
        return _write(rows, path, [DAY], "customer_id", mode)
    tiers = t.customers.select("customer_id", F.col("customer_tier").alias(TIER))
    _write(rows.join(tiers, "customer_id", "left"), path, [MONTH, TIER], "customer_id", mode)


def write_lines(t: Tables, path: str, by: str = DAY, mode: str = "errorifexists") -> None:
    """Write the lines of ``t.orders`` in folders of their order's day or month."""
    periods = t.orders.select("order_id", _period(by).alias(by))
    lines = likely_lines(t.order_items, t.orders)
    _write(lines.join(periods, "order_id"), path, [by], "order_id", mode)


def likely_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """All lines of ``orders`` and few others, so that a join moves little else.

    An append holds the orders of some days; the lines of all others need not be shuffled.
    """
    filled = pinned(key_filter(orders.select("order_id"), ["order_id"]))
    marked = maybe_among(lines, filled, ["order_id"], "_maybe")
    return marked.filter("_maybe").drop("_maybe")


def read_rows(spark: SparkSession, path: str, columns: T.StructType, by: str = MONTH) -> DataFrame:
    """What ``write_orders`` or ``write_lines`` wrote; ``columns`` are those of the table."""
    folders = T.StructType(columns.fields + [T.StructField(by, T.DateType())])
    if by == MONTH and "customer_id" in columns.names:
        folders.add(TIER, T.StringType())
    return spark.read.schema(folders).parquet(path)


def in_dates(
    orders: DataFrame, first: dt.date | Column | None = None, last: dt.date | Column | None = None
) -> DataFrame:
    """Orders from day ``first`` to day ``last``, both included; of a layout, few folders."""
    date = F.col("order_date")
    for bound, keep in ((first, Column.__ge__), (last, Column.__le__)):
        if bound is None:
            continue
        bound = bound if isinstance(bound, Column) else day(bound)
        orders = orders.filter(keep(date, bound))
        if MONTH in orders.columns:
            orders = orders.filter(keep(F.col(MONTH), month_start(bound)))
        if DAY in orders.columns:
            orders = orders.filter(keep(F.col(DAY), bound))
    return orders


def in_periods(orders: DataFrame, periods: DataFrame) -> DataFrame:
    """Orders of the months or days that ``periods`` names, as chosen rows of a calendar.

    ``periods`` has one column, of the layout's name, at most a row per day of the calendar;
    it is broadcast, and its rows prune the folders while the query runs.
    """
    (by,) = periods.columns
    return orders.join(F.broadcast(periods.distinct()), by, "left_semi")


def in_tiers(orders: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Orders of customers of ``tiers``, from their folders."""
    return orders.filter(F.col(TIER).isin(*tiers))
