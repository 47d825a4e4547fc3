"""Connected components by alternating large-star and small-star steps.

Every step is a minimum per node and a join with it; a node with very many links is
reduced by partial minima, and AQE splits its side of the join. Links are rewritten to
the written copy in the checkpoint folder after each round, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.llm.common import release_shuffles
from shoplytic.session import pinned


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the node's least neighbour."""
    both = links.select("high", "low").union(
        links.select(F.col("low").alias("high"), F.col("high").alias("low"))
    )
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return (
        both.filter(F.col("other") > F.col("node"))
        .join(least, "node")
        .select(F.col("other").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, get linked to the least of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    joined = links.join(least, "high")
    return (
        joined.filter(F.col("low") != F.col("least"))
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
        .union(least.select("high", F.col("least").alias("low")))
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free sum over the links: equal when nothing changed."""
    mark = F.xxhash64("high", "low").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(mark)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` for every node of the links (``a``, ``b``): the least id reachable.

    Links may repeat, point either way or join a node with itself. No links, no rows.
    """
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    own = links.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id")).distinct()
    stars = pinned(links.filter(F.col("a") != F.col("b")).select(high, low).distinct())
    before = _state(stars)
    while True:
        stars = pinned(_small_star(_large_star(stars)))
        after = _state(stars)
        release_shuffles(links.sparkSession)
        if after == before:
            break
        before = after
    members = stars.select(F.col("high").alias("id"), F.col("low").alias("component"))
    centres = stars.select(F.col("low").alias("id")).distinct()
    alone = centres.union(own).distinct().select("id", F.col("id").alias("component"))
    return members.union(alone.join(members, "id", "left_anti"))
