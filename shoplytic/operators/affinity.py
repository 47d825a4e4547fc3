"""Products bought together.

Listing every pair inside every basket would let a few huge baskets make up the
whole job. With a support threshold of m there is an exact way round most of it,
known from set-similarity joins as prefix filtering. Order all baskets by size and
split every product's baskets into a tail, its m - 1 largest, and a head, the rest.
Two products that share m baskets share at least one that is in the head of both:
the smallest shared one has m - 1 larger shared ones behind it. So pairs are listed
from heads only, where the huge baskets hardly occur, and the tails, at most m - 1
baskets per product, only add to the counts of pairs already found.

Small baskets have few pairs, so they stay in the heads whatever their rank: a
shorter tail is just as exact. ``ordinary_size`` says what is small; it moves work
between the two steps and never changes the result.

A pair is kept for the second step only if its count in the heads and what the two
tails can add reach the threshold. Large baskets left in the heads are cut into
blocks of rows, and the pairs of every two blocks are a join key of their own, so
the pairs of one basket come from many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.functions.numeric import ratio
from shoplytic.operators.products import sold_items
from shoplytic.schema import Tables, valid_orders
from shoplytic.session import pinned

PAIR = ["product_a", "product_b"]
# Rows of a basket that are paired in one join key, about.
BLOCK_ROWS = 128


def baskets(t: Tables) -> DataFrame:
    """Distinct products per valid order."""
    return sold_items(t).select("order_id", "product_id").distinct()


def _named(lines: DataFrame, product: str) -> DataFrame:
    return lines.select("order_id", F.col("product_id").alias(product))


def _tails(lines: DataFrame, rows: int, ordinary_size: int) -> DataFrame:
    """The ``rows`` largest baskets of every product, of those above ordinary size.

    Each task keeps its own largest rows per product before they move, so a
    product in very many baskets arrives as few rows.
    """
    largest = Window.partitionBy("product_id").orderBy(
        F.col("size").desc(), F.col("order_id").desc()
    )
    return (
        lines.filter(F.col("size") > ordinary_size)
        .withColumn("place", F.row_number().over(largest))
        .filter(F.col("place") <= rows)
        .select("order_id", "product_id")
    )


def _block_pairs(heads: DataFrame) -> DataFrame:
    """Every pair of a basket once, from joins of blocks of its rows.

    The number of partitions is given, so AQE does not merge them by their few input
    bytes: what counts here is the pairs that come out.
    """
    blocks = F.ceil(F.col("size") / BLOCK_ROWS)
    rows = heads.select(
        "order_id", "product_id", F.pmod(F.xxhash64("product_id"), blocks).alias("block"),
        blocks.alias("blocks"),
    )
    low = rows.select(
        "order_id",
        F.col("block").alias("low_block"),
        F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high_block"),
        F.col("product_id").alias("x"),
    )
    high = rows.select(
        "order_id",
        F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("low_block"),
        F.col("block").alias("high_block"),
        F.col("product_id").alias("y"),
    )
    key = ["order_id", "low_block", "high_block"]
    tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = low.repartition(tasks, *key).join(high.repartition(tasks, *key), key)
    # Within one block each pair comes both ways.
    once = (F.col("low_block") < F.col("high_block")) | (F.col("x") < F.col("y"))
    return met.filter(once).select(
        F.least("x", "y").alias("product_a"), F.greatest("x", "y").alias("product_b")
    )


def _candidates(lines: DataFrame, tails: DataFrame, min_pair_orders: int) -> DataFrame:
    """``in_heads`` of all pairs that can still reach the threshold."""
    heads = lines.join(tails, ["order_id", "product_id"], "left_anti")
    found = _block_pairs(heads).groupBy(PAIR).agg(F.count("*").alias("in_heads"))
    behind = tails.groupBy("product_id").agg(F.count("*").alias("rows"))
    for product in PAIR:
        found = found.join(
            behind.select(
                F.col("product_id").alias(product), F.col("rows").alias(f"behind_{product}")
            ),
            product,
            "left",
        )
    possible = F.col("in_heads")
    for product in PAIR:
        possible = possible + F.coalesce(f"behind_{product}", F.lit(0))
    return found.filter(possible >= min_pair_orders).select(*PAIR, "in_heads")


def _pair_counts(lines: DataFrame, min_pair_orders: int, ordinary_size: int) -> DataFrame:
    """Exact ``pair_orders`` of all pairs that reach the threshold."""
    tails = pinned(_tails(lines, min_pair_orders - 1, ordinary_size))
    found = pinned(_candidates(lines, tails, min_pair_orders))
    heads = lines.join(tails, ["order_id", "product_id"], "left_anti")
    # The shared baskets not counted yet: in a's tail, or in b's tail and a's head.
    in_tail_of_a = (
        found.select(PAIR)
        .join(_named(tails, "product_a"), "product_a")
        .join(_named(lines, "product_b"), ["order_id", "product_b"])
    )
    in_tail_of_b = (
        found.select(PAIR)
        .join(_named(tails, "product_b"), "product_b")
        .join(_named(heads, "product_a"), ["order_id", "product_a"])
    )
    more = (
        in_tail_of_a.select(PAIR)
        .unionByName(in_tail_of_b.select(PAIR))
        .groupBy(PAIR)
        .agg(F.count("*").alias("in_tails"))
    )
    total = F.col("in_heads") + F.coalesce("in_tails", F.lit(0))
    return (
        found.join(more, PAIR, "left")
        .select(*PAIR, total.alias("pair_orders"))
        .filter(F.col("pair_orders") >= min_pair_orders)
    )


def product_affinity(
    t: Tables, min_pair_orders: int = 2, ordinary_size: int = 32
) -> DataFrame:
    """Pairs ``a < b`` in at least ``min_pair_orders`` baskets.

    Columns: baskets with both, support, confidence each way, lift. The baskets are
    pinned while the plan is built, so this call runs jobs.
    """
    if min_pair_orders < 2:
        raise ValueError("min_pair_orders must be at least 2")

    # A product in fewer baskets than the threshold is in no qualifying pair.
    bought = pinned(baskets(t))
    support = bought.groupBy("product_id").agg(F.count("*").alias("orders"))
    frequent = pinned(support.filter(F.col("orders") >= min_pair_orders))
    lines = bought.join(frequent.select("product_id"), "product_id", "left_semi")
    sizes = lines.groupBy("order_id").agg(F.count("*").alias("size"))
    lines = pinned(lines.join(sizes, "order_id"))

    counted = _pair_counts(lines, min_pair_orders, ordinary_size)
    all_orders = valid_orders(t).agg(F.count("*")).scalar()
    of_a = frequent.select(F.col("product_id").alias("product_a"), F.col("orders").alias("a"))
    of_b = frequent.select(F.col("product_id").alias("product_b"), F.col("orders").alias("b"))
    both, a, b = F.col("pair_orders"), F.col("a"), F.col("b")
    return (
        counted.join(of_a, "product_a")
        .join(of_b, "product_b")
        .select("*", all_orders.alias("n"))
        .select(
            "product_a",
            "product_b",
            "pair_orders",
            ratio(both, F.col("n")).alias("support"),
            ratio(both, a).alias("confidence_a_to_b"),
            ratio(both, b).alias("confidence_b_to_a"),
            (ratio(both, a) / ratio(b, F.col("n"))).alias("lift"),
        )
    )
