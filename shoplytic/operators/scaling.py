"""Standardisation: every column less its mean, over its population deviation.

Moments (count, mean, sum of squared deviations) of all columns come from one aggregation
that sums partially in every task. Moments of parts merge without reading the rows again, so
they can be kept per day or per file. A fitted scaling is applied as column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``column_name, n, mean, squares`` per column, and per group of ``by``; nulls don't count."""
    parts = []
    for c in columns:
        value = F.col(c).cast("double")
        n = F.count(value)
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                n.alias("n"),
                F.avg(value).alias("mean"),
                (F.var_pop(value) * n).alias("squares"),
            )
        )
    return df.groupBy(*by).agg(F.array(*parts).alias("parts")).select(*by, F.inline("parts"))


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The moments of all rows from those of disjoint parts.

    With the mean of all known, a part adds its own squares and its count times the squared
    distance of its mean. Parts without rows add nothing.
    """
    key = [*by, "column_name"]
    whole = parts.groupBy(*key).agg(
        F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre")
    )
    apart = F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2)
    return (
        parts.join(whole, key)
        .groupBy(*key)
        .agg(
            F.max("all").alias("n"),
            F.max("centre").alias("mean"),
            F.sum(F.col("squares") + apart).alias("squares"),
        )
    )


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per column; a deviation of 0 scales by 1."""

    means: dict[str, float]
    deviations: dict[str, float]

    def _divisor(self, column: str) -> float:
        return self.deviations[column] or 1.0

    def expression(self, column: str) -> Column:
        """The standardised column; null stays null."""
        return (F.col(column).cast("double") - F.lit(self.means[column])) / F.lit(
            self._divisor(column)
        )

    def apply(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return df.withColumns({f"{prefix}{c}": self.expression(c) for c in self.means})

    def sql(self, prefix: str) -> str:
        """The standardised columns as SQL, for a stage that is saved with a model."""
        return ", ".join(
            f"(CAST({c} AS DOUBLE) - {self.means[c]!r}D) / {self._divisor(c)!r}D AS {prefix}{c}"
            for c in self.means
        )


def scaling_of(found: DataFrame) -> Scaling:
    """The scaling from ``moments`` or ``merged``; a row per column."""
    rows = {r["column_name"]: r for r in found.collect()}
    return Scaling(
        {c: r["mean"] or 0.0 for c, r in rows.items()},
        {c: (r["squares"] / r["n"]) ** 0.5 if r["n"] else 0.0 for c, r in rows.items()},
    )


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    return scaling_of(moments(df, columns))
