"""Ratios, shares and roundings with one definition each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; null for a zero or null denominator."""
    bottom = denominator.cast("double")
    return numerator.cast("double") / F.when(bottom != 0, bottom)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Double quotient where the denominator is positive, else 0."""
    bottom = denominator.cast("double")
    return F.when(bottom > 0, numerator.cast("double") / bottom).otherwise(F.lit(0.0))


def mean_of(total: Column, count: Column) -> Column:
    """Average from an exact decimal sum, free of summation order."""
    return ratio(total, count)


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a rounded percentage of ``whole``; null when ``whole`` is 0."""
    bottom = whole.cast("double")
    return F.round(part.cast("double") * 100.0 / F.when(bottom != 0, bottom), digits)


def growth_pct(current: Column, previous: Column, digits: int = 1) -> Column:
    """Rounded percentage change; null without a previous value or when it is 0."""
    return share_pct(current - previous, previous, digits)


def quotient_to_cents(numerator: Column, count: Column) -> Column:
    """``numerator / count`` to two decimals, half away from zero, without error.

    A decimal division keeps only a few digits before the rounding sees them, so
    the half-cent decision is made on whole numbers instead. ``numerator`` is a
    decimal with at most four decimals, ``count`` a positive whole number.
    """
    units = (F.abs(numerator) * 10000).cast("decimal(38,0)")
    twice_hundredths = units * 2 + count.cast("decimal(38,0)") * 100
    cents = F.call_function("div", twice_hundredths, count.cast("decimal(38,0)") * 200)
    signed = F.when(numerator < 0, -cents).otherwise(cents)
    return (signed.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def as_number(value: Column) -> Column:
    """Double, with anything unreadable or missing as 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def clamp(value: Column, low, high) -> Column:
    """``value`` kept inside ``[low, high]``."""
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
