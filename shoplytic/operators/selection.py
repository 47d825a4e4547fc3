"""Exact order statistics by counting, without a sort.

A pass counts the rows in a few thousand equal cells between two bounds and keeps each
cell's least and greatest value. The value looked for lies in one cell, whose ends are the
next bounds; when they are equal, it is found. A pass exchanges one row per cell and task,
however many rows there are or however often a value repeats. Any number of positions are
looked for in the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytic.session import pinned

CELLS = 2048


@dataclass(frozen=True)
class Span:
    """Values from ``low`` to ``high``, with ``before`` rows below ``low``."""

    low: object
    high: object
    before: int


def _cell(value: Column, span: Span, cells: int) -> Column:
    """Which of the cells of ``span`` a value is in: never less for a greater value."""
    low, high = F.lit(span.low), F.lit(span.high)
    share = (value - low).cast("double") / (high - low).cast("double")
    return F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")


def order_statistics(
    df: DataFrame, value: str, positions: Sequence[int], cells: int = CELLS
) -> list:
    """The values at ``positions`` (from 1) of the non-null ``value`` in ascending order.

    ``value`` is a whole number, a decimal or a double without NaN. A position beyond the
    rows gives None.
    """
    values = pinned(df.select(F.col(value).alias("v")).filter("v IS NOT NULL"))
    whole = values.agg(F.count("*").alias("rows"), F.min("v"), F.max("v")).first()
    wanted = {p: Span(whole[1], whole[2], 0) for p in positions if 1 <= p <= whole["rows"]}
    found = {}
    while wanted:
        for p, span in list(wanted.items()):
            if span.low == span.high:
                found[p] = span.low
                del wanted[p]
        spans = sorted(set(wanted.values()), key=lambda s: s.before)
        if not spans:
            break
        v = F.col("v")
        number, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, span in enumerate(spans):
            inside = v.between(F.lit(span.low), F.lit(span.high))
            number = F.when(inside, k).otherwise(number)
            cell = F.when(inside, _cell(v, span, cells)).otherwise(cell)
        counted = (
            values.select("v", number.alias("span"), cell.alias("cell"))
            .filter("span IS NOT NULL")
            .groupBy("span", "cell")
            .agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        )
        # A row per span and cell: a constant, whatever the data.
        tables: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda r: (r["span"], r["cell"])):
            tables.setdefault(row["span"], []).append(row)
        for p, span in list(wanted.items()):
            before = span.before
            for row in tables[spans.index(span)]:
                if before + row["rows"] >= p:
                    wanted[p] = Span(row["low"], row["high"], before)
                    break
                before += row["rows"]
    return [found.get(p) for p in positions]


def row_count(df: DataFrame, value: str) -> int:
    return df.agg(F.count(value)).first()[0]


def quantiles(df: DataFrame, value: str, parts: int) -> list:
    """The upper limits of ``parts`` equal shares of the rows: the value at row ceil(k n / parts)."""
    rows = row_count(df, value)
    return order_statistics(df, value, [-(-k * rows // parts) for k in range(1, parts + 1)])


def median(df: DataFrame, value: str) -> float | None:
    """The middle value, or the mean of the two middle ones; None without rows."""
    rows = row_count(df, value)
    low, high = order_statistics(df, value, [(rows + 1) // 2, rows // 2 + 1])
    return None if low is None else (float(low) + float(high)) / 2


def quantile_limits(df: DataFrame, value: str, parts: int = 4) -> DataFrame:
    """``part, limit, rows_up_to``: the quantiles, and the rows not above each."""
    spark = df.sparkSession
    values = pinned(df.select(value))
    limits = quantiles(values, value, parts)
    kind = dict(values.dtypes)[value]
    frame = spark.createDataFrame(list(enumerate(limits, 1)), f"part int, limit {kind}")
    counts = [F.count_if(F.col(value) <= F.lit(limit)) for limit in limits]
    rows = values.agg(F.array(*counts).alias("rows"))
    return frame.join(F.broadcast(rows)).select(
        "part", "limit", F.get("rows", F.col("part") - 1).alias("rows_up_to")
    )
