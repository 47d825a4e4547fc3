"""Row filters a report reader picks; an empty choice means no filter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_N_STEP = 5
TOP_N_MAX = 100


def one_of(df: DataFrame, column: str, choices: Sequence | None) -> DataFrame:
    return df.filter(F.col(column).isin(*choices)) if choices else df


def revenue_filtered(
    monthly: DataFrame, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Months from ``start`` to ``end``, both included; both must be given."""
    if start is None or end is None:
        return monthly
    return monthly.filter(F.col("month").between(F.lit(start), F.lit(end)))


def customers_filtered(customers: DataFrame, tiers: Sequence[str] | None = None) -> DataFrame:
    return one_of(customers, "customer_tier", tiers)


def products_filtered(products: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    return one_of(products, "category_name", categories)


def by_id(df: DataFrame, column: str, ids: Sequence | DataFrame | None) -> DataFrame:
    """Rows whose ``column`` is among ``ids``; None or an empty list keeps all.

    Pass many ids as a frame with a column of the same name.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column), column, "left_semi")
    return one_of(df, column, ids)


def checked_top_n(n: int) -> int:
    """``n`` if a reader may choose it: 5, 10, ... 100."""
    if n % TOP_N_STEP or not TOP_N_STEP <= n <= TOP_N_MAX:
        raise ValueError(f"n must be a multiple of {TOP_N_STEP} up to {TOP_N_MAX}, got {n}")
    return n
