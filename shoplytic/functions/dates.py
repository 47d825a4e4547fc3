"""Calendar expressions; weekday numbering differs by caller, so both are named."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: dt.date) -> Column:
    return F.lit(value).cast("date")


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def whole_months(later: Column, earlier: Column) -> Column:
    """Months from one month start to another."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def weekday_from_sunday(date: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(date) - 1


def weekday_from_monday(date: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(date)


def days_before(value: dt.date, days: int) -> dt.date:
    return value - dt.timedelta(days=days)
