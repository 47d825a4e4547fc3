"""Customer spending, ranking and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.functions.dates import day
from shoplytic.functions.labels import full_name
from shoplytic.functions.numeric import share_pct
from shoplytic.operators.filters import checked_top_n
from shoplytic.operators.ranking import global_ranks
from shoplytic.schema import Tables, valid_orders


def order_sums(orders: DataFrame) -> DataFrame:
    """Order count and amount per customer.

    Summed before any join, so a customer with very many orders is one row
    per task by the time rows move.
    """
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("total_amount").alias("total_spent"),
    )


def customer_spending(t: Tables) -> DataFrame:
    """Every customer with the count and amount of valid orders, 0 without any."""
    return t.customers.join(order_sums(valid_orders(t)), "customer_id", "left").select(
        "customer_id",
        "first_name",
        "last_name",
        "customer_tier",
        "registration_date",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("total_spent", F.lit(0).cast("decimal(28,2)")).alias("total_spent"),
    )


def paying_customers(t: Tables) -> DataFrame:
    return customer_spending(t).filter(F.col("total_spent") > 0).drop("registration_date")


def customer_ranking(t: Tables) -> DataFrame:
    """Paying customers with overall rank, rank inside the tier and revenue share."""
    ranked = global_ranks(
        paying_customers(t),
        value="total_spent",
        tie_break="customer_id",
        within=["customer_tier"],
        row_number="overall_rank",
        rank="rank_in_tier",
    )
    return ranked.select(
        "customer_id",
        "first_name",
        "last_name",
        "customer_tier",
        "total_orders",
        F.round("total_spent", 2).alias("total_spent"),
        "overall_rank",
        "rank_in_tier",
        share_pct(F.col("total_spent"), F.col("value_total")).alias("pct_of_total_revenue"),
    )


def _with_share(paying: DataFrame) -> DataFrame:
    # AQE reuses the exchange of the sums per customer for the total: orders are read once.
    whole = paying.agg(F.sum("total_spent")).scalar()
    return paying.withColumn(
        "pct_of_total_revenue", share_pct(F.col("total_spent"), whole)
    )


def top_customers(t: Tables, n: int = 20) -> DataFrame:
    """The ``n`` biggest spenders with a display name and their revenue share."""
    top = _with_share(paying_customers(t)).orderBy(
        F.col("total_spent").desc(), F.col("customer_id")
    )
    return top.limit(n).select(
        "customer_id",
        full_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
        "customer_tier",
        "total_orders",
        "total_spent",
        "pct_of_total_revenue",
    )


def chosen_top_customers(t: Tables, n: int) -> DataFrame:
    """As ``top_customers``, for a number that a reader picked from the allowed ones."""
    return top_customers(t, checked_top_n(n))


def top_customer_concentration(t: Tables, n: int = 10) -> DataFrame:
    """One row with the summed share of the top ``n``; none with fewer customers."""
    return (
        top_customers(t, n)
        .agg(
            F.count("*").alias("customers"),
            F.sum(F.col("pct_of_total_revenue").cast("decimal(12,2)")).alias("top_n_pct"),
        )
        .filter(F.col("customers") == n)
    )


def top_spenders(t: Tables, n: int = 10) -> DataFrame:
    """Top ``n`` of all customers, those without orders included."""
    return (
        customer_spending(t)
        .select("customer_id", "customer_tier", "registration_date", "total_orders", "total_spent")
        .orderBy(F.col("total_spent").desc(), F.col("customer_id"))
        .limit(n)
    )


def top_spenders_summary(t: Tables, n: int = 10) -> DataFrame:
    return top_spenders(t, n).agg(
        F.count("*").alias("customers"),
        F.max("total_spent").alias("highest_spent"),
        F.max("total_orders").alias("most_orders"),
    )


def tier_summary(t: Tables) -> DataFrame:
    """Customers, revenue and orders per tier, over paying customers."""
    return (
        paying_customers(t)
        .groupBy("customer_tier")
        .agg(
            F.count("customer_id").alias("customers"),
            F.sum(F.round("total_spent", 2)).alias("total_spent"),
            F.sum("total_orders").alias("total_orders"),
        )
    )


def paying_in_tier(t: Tables, tier: str = "Platinum") -> DataFrame:
    """One row: how many paying customers one tier has."""
    return (
        paying_customers(t)
        .filter(F.col("customer_tier") == tier)
        .agg(F.count("*").alias("customers"))
    )


def tier_distribution(t: Tables) -> DataFrame:
    """All customers per tier, largest tier first."""
    return (
        t.customers.groupBy("customer_tier")
        .agg(F.count("*").alias("customer_count"))
        .orderBy(F.col("customer_count").desc(), "customer_tier")
    )


def order_activity(t: Tables, as_of, n: int = 5) -> DataFrame:
    """Tenure and order count, any status, for the first ``n`` customers by id."""
    first = t.customers.orderBy("customer_id").limit(n)
    shown = F.broadcast(first.select("customer_id"))  # n rows
    orders = t.orders.join(shown, "customer_id", "left_semi").groupBy("customer_id")
    counts = orders.agg(F.count("order_id").alias("total_orders"))
    return first.join(counts, "customer_id", "left").select(
        "customer_id",
        "customer_tier",
        F.datediff(day(as_of), "registration_date").alias("days_since_registration"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
    ).orderBy("customer_id")
