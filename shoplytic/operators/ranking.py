"""Ranks and quartiles over a whole table without gathering it in one task.

A window without PARTITION BY sends every row to one task, and one by customer
tier sends a tier to one task. Here the rows are range-sorted once into many
partitions and that layout is pinned in the checkpoint folder. Rank then needs
only local numbering inside a partition plus an offset: how many rows the earlier
partitions hold. The offsets come from a frame with one row per partition and
group, so its size follows the partition count and not the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytic.operators.selection import median
from shoplytic.session import pinned

# monotonically_increasing_id keeps the partition number above this bit.
_ROW_BITS = 33


def in_sorted_slices(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-sorted, with its partition ``_slice`` and 0-based row ``_row``."""
    numbered = pinned(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return numbered.select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).alias("_slice"),
        F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
    )


def global_ranks(
    df: DataFrame,
    value: str,
    tie_break: str,
    within: Sequence[str] = (),
    row_number: str = "row_number",
    rank: str = "rank",
    rows: str = "rows_total",
    total: str = "value_total",
) -> DataFrame:
    """Add exact descending ranks by ``value``, which must not be null.

    ``row_number``: position in the whole table, ties ordered by ``tie_break``.
    ``rank``: SQL ``rank()`` inside the ``within`` group, ties equal.
    ``rows`` and ``total``: row count and sum of ``value`` over the whole table.
    """
    # A struct compares equal to itself even with null fields, so a null group joins.
    group = F.struct(*within) if within else F.lit(0)
    sliced = in_sorted_slices(df, F.col(value).desc(), F.col(tie_break).asc())
    sliced = sliced.withColumn("_group", group)

    in_group = Window.partitionBy("_slice", "_group").orderBy(F.col(value).desc())
    local = sliced.withColumn("_local_rank", F.rank().over(in_group))

    # One row per slice and group from here to the join.
    sizes = local.groupBy("_slice", "_group").agg(
        F.count("*").alias("_rows"),
        F.sum(value).alias("_sum"),
        F.max(value).alias("_first"),
        F.min(value).alias("_last"),
        F.max("_local_rank").alias("_last_local_rank"),
    )
    slice_order = Window.partitionBy("_group").orderBy("_slice")
    earlier = slice_order.rowsBetween(Window.unboundedPreceding, -1)
    earlier_slices = Window.orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sizes.select(
        "*",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_group_offset"),
        F.coalesce(F.sum("_rows").over(earlier_slices), F.lit(0)).alias("_slice_offset"),
        F.sum("_rows").over(everything).alias("_all_rows"),
        F.sum("_sum").over(everything).alias("_all_sum"),
    )
    # A run of equal values may start in an earlier slice: its rank is the rank
    # at the first slice that ends with that value.
    same_last = Window.partitionBy("_group", "_last")
    offsets = offsets.withColumn(
        "_run_rank", F.min(F.col("_group_offset") + F.col("_last_local_rank")).over(same_last)
    ).select(
        "*",
        F.when(
            F.lag("_last").over(slice_order) == F.col("_first"),
            F.lag("_run_rank").over(slice_order),
        )
        .otherwise(F.col("_group_offset") + 1)
        .alias("_first_rank"),
    )
    offsets = offsets.select(
        "_slice", "_group", "_first", "_group_offset", "_slice_offset", "_first_rank",
        "_all_rows", "_all_sum",
    )

    return local.join(offsets, ["_slice", "_group"]).select(
        *df.columns,
        (F.col("_slice_offset") + F.col("_row") + 1).alias(row_number),
        F.when(F.col(value) == F.col("_first"), F.col("_first_rank"))
        .otherwise(F.col("_group_offset") + F.col("_local_rank"))
        .alias(rank),
        F.col("_all_rows").alias(rows),
        F.col("_all_sum").alias(total),
    )


def ntile(position: Column, rows: Column, buckets: int) -> Column:
    """SQL ``ntile`` from a row number and the row count: larger buckets first."""
    small = F.floor(rows / buckets)
    larger = rows % buckets
    in_larger = larger * (small + 1)
    return F.when(
        position <= in_larger, F.floor((position - 1) / (small + 1)) + 1
    ).otherwise(larger + F.floor((position - in_larger - 1) / F.greatest(small, F.lit(1))) + 1)


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the interpolated median of the non-null ``value``, as ``median``."""
    return df.sparkSession.createDataFrame([(median(df, value),)], "median double")
