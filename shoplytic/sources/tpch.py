"""TPC-H-like tables seen as the shop's tables.

Statuses keep their raw codes (F delivered, P shipped, O pending), so the
valid-order filter is pushed into the scan. Columns that cost a join or an
aggregate here (registration date, order discount) sit behind left joins on
unique keys; the optimizer drops them when a query does not ask for them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytic.schema import MONEY, Tables

AS_OF = dt.date(2001, 8, 1)
FIRST_DAY = dt.date(1995, 1, 1)
VALID = ("F", "P")
STATUSES = ("F", "P", "O")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def order_items(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    rate = F.col("l_discount").cast("decimal(4,2)")
    return lineitem.select(
        F.col("l_linenumber").cast("long").alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        price.alias("unit_price"),
        (price * (1 - rate)).alias("line_total"),
        (price * rate).alias("discount_applied"),
    )


def orders(raw: DataFrame, lineitem: DataFrame) -> DataFrame:
    items = order_items(lineitem)
    sums = items.groupBy("order_id").agg(
        F.sum("line_total").alias("subtotal"),
        F.sum("discount_applied").alias("discount_amount"),
    )
    base = raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
    )
    nothing = F.lit(0).cast("decimal(18,4)")
    return base.join(sums, "order_id", "left").select(
        *base.columns,
        F.coalesce("subtotal", nothing).alias("subtotal"),
        F.lit(0).cast(MONEY).alias("tax_amount"),
        F.lit(0).cast(MONEY).alias("shipping_cost"),
        F.coalesce("discount_amount", nothing).alias("discount_amount"),
    )


def customers(raw: DataFrame, raw_orders: DataFrame) -> DataFrame:
    first_order = raw_orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min("o_orderdate").cast("date").alias("first_order_date")
    )
    base = raw.select(
        F.col("c_custkey").alias("customer_id"),
        F.substring_index("c_name", "#", 1).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.col("c_mktsegment").alias("customer_tier"),
    )
    return base.join(first_order, "customer_id", "left").select(
        *base.columns,
        F.coalesce("first_order_date", F.lit(FIRST_DAY)).alias("registration_date"),
    )


def _category_id(kind):
    return F.crc32(kind.cast("binary")).alias("category_id")


def products(part: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast(MONEY)
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        _category_id(F.col("p_type")),
        F.col("p_brand").alias("brand"),
        price.alias("unit_cost"),
        price.alias("selling_price"),
        (F.col("p_size") % 4 != 0).alias("is_active"),
    )


def categories(part: DataFrame) -> DataFrame:
    kinds = part.select("p_type").distinct()
    return kinds.select(_category_id(F.col("p_type")), F.col("p_type").alias("category_name"))


def customer_addresses(raw: DataFrame, nation: DataFrame) -> DataFrame:
    homes = raw.join(nation, raw.c_nationkey == nation.n_nationkey, "left")
    return homes.select(
        F.col("c_custkey").alias("customer_id"),
        F.lit("shipping").alias("address_type"),
        F.col("n_name").alias("country"),
        F.lit(True).alias("is_primary"),
    )


def load(spark: SparkSession, folder: str) -> Tables:
    """The shop's tables over ``folder/*.parquet``."""
    raw = {name: table(spark, folder, name) for name in SCHEMAS}
    return Tables(
        customers=customers(raw["customer"], raw["orders"]),
        products=products(raw["part"]),
        categories=categories(raw["part"]),
        customer_addresses=customer_addresses(raw["customer"], raw["nation"]),
        orders=orders(raw["orders"], raw["lineitem"]),
        order_items=order_items(raw["lineitem"]),
        valid_statuses=VALID,
        statuses=STATUSES,
        tiers=SEGMENTS,
    )
