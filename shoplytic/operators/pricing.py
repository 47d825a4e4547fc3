"""Order pricing rules and catalogue labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytic.functions.labels import (
    email_address,
    product_blurb,
    shorten,
    stock_code,
)
from shoplytic.schema import Tables

# Tax, shipping and tier discount rules.
TAX_RATE = "0.21"
FREE_SHIPPING_OVER = "50"
SHIPPING_FEE = "5.95"
TIER_DISCOUNTS = {"Gold": "0.05", "Platinum": "0.10"}
TIER_DISCOUNT_SHARES = {"Gold": 20, "Platinum": 30}
DEFAULT_TIER = "Bronze"

# Field lengths.
NAME_LENGTH = 100
PHONE_LENGTH = 20
GENDER_LENGTH = 20


def line_total(quantity: Column, unit_price: Column, discount: Column) -> Column:
    """The discount is per line, not per unit."""
    return quantity * unit_price - discount


def _lookup(values: Mapping[str, object], key: Column, default: Column) -> Column:
    result = default
    for name, value in values.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def order_totals(
    t: Tables,
    tax_rate: str = TAX_RATE,
    free_over: str = FREE_SHIPPING_OVER,
    fee: str = SHIPPING_FEE,
    tier_rates: Mapping[str, str] = TIER_DISCOUNTS,
    tier_shares: Mapping[str, int] = TIER_DISCOUNT_SHARES,
) -> DataFrame:
    """Price every order from its lines: subtotal, tax, shipping, tier discount, total.

    ``eligible_discount`` is what the tier allows; ``discount_amount`` grants it
    to the tier's share (in percent) of orders, chosen by order number.
    """
    money = "decimal(18,2)"
    lines = t.order_items.groupBy("order_id").agg(F.sum("line_total").alias("lines_total"))
    tiers = t.customers.select("customer_id", "customer_tier")
    tier = F.coalesce("customer_tier", F.lit(DEFAULT_TIER))
    subtotal = F.col("subtotal")
    rate = _lookup(tier_rates, F.col("tier"), F.lit("0")).cast("decimal(4,2)")
    share = _lookup(tier_shares, F.col("tier"), F.lit(0))
    granted = F.pmod(F.col("order_id"), F.lit(100)) < share
    nothing = F.lit(0).cast(money)
    priced = (
        t.orders.select("order_id", "customer_id")
        .join(lines, "order_id", "left")
        .join(tiers, "customer_id", "left")
        .select(
            "order_id",
            "customer_id",
            tier.alias("tier"),
            F.coalesce("lines_total", F.lit(0)).cast("decimal(18,4)").alias("subtotal"),
        )
        .select(
            "*",
            F.round(subtotal * F.lit(tax_rate).cast("decimal(4,2)"), 2).alias("tax_amount"),
            F.when(subtotal > F.lit(free_over).cast(money), nothing)
            .otherwise(F.lit(fee).cast(money))
            .alias("shipping_cost"),
            F.round(subtotal * rate, 2).alias("eligible_discount"),
        )
        .withColumn(
            "discount_amount", F.when(granted, F.col("eligible_discount")).otherwise(nothing)
        )
    )
    return priced.withColumn(
        "total_amount",
        subtotal + F.col("tax_amount") + F.col("shipping_cost") - F.col("discount_amount"),
    )


def product_labels(t: Tables) -> DataFrame:
    """Stock code and description; the code's five digits come from the product number."""
    number = F.pmod(F.col("product_id"), F.lit(90000)) + 10000
    return t.products.select(
        "product_id",
        stock_code(F.col("brand"), number).alias("sku"),
        product_blurb(F.col("product_name"), F.col("brand")).alias("description"),
    )


def customer_labels(t: Tables, mail_domain: str = "example.com") -> DataFrame:
    """Mail address and names cut to their field lengths."""
    first, last = F.col("first_name"), F.col("last_name")
    number = F.pmod(F.col("customer_id"), F.lit(999)) + 1
    return t.customers.select(
        "customer_id",
        email_address(first, last, number, F.lit(mail_domain)).alias("email"),
        shorten(first, NAME_LENGTH).alias("first_name"),
        shorten(last, NAME_LENGTH).alias("last_name"),
    )


def combined_catalogue(
    lists: Mapping[str, DataFrame], categories: DataFrame, default: str | None = None
) -> DataFrame:
    """Product lists put together, each tagged with its category name and id.

    A list whose name is no known category falls under ``default``.
    """
    tagged = None
    for name, products in lists.items():
        part = products.drop("category_id").withColumn("category_name", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    known = categories.select("category_name", "category_id")
    joined = tagged.join(known, "category_name", "left")
    if default is None:
        return joined
    missing = F.col("category_id").isNull()
    fallback = known.filter(F.col("category_name") == default)
    fallback_id = fallback.agg(F.max("category_id")).scalar()
    return joined.select(
        *[c for c in joined.columns if c not in ("category_name", "category_id")],
        F.when(missing, F.lit(default)).otherwise(F.col("category_name")).alias("category_name"),
        F.when(missing, fallback_id).otherwise(F.col("category_id")).alias("category_id"),
    )
