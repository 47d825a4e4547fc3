"""Text labels and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Churn risk bands, each open at its lower and closed at its upper end.
RISK_BANDS = (
    (0.0, 0.3, "Low Risk"),
    (0.3, 0.7, "Medium Risk"),
    (0.7, 1.0, "High Risk"),
)
RISK_LEVELS = tuple(label for _, _, label in RISK_BANDS)


def risk_level(probability: Column) -> Column:
    """Band of a churn probability; a probability of exactly 0 has none."""
    bands = [
        F.when((probability > low) & (probability <= high), F.lit(label))
        for low, high, label in RISK_BANDS
    ]
    return F.coalesce(*bands)


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def email_address(first: Column, last: Column, number: Column, domain: Column) -> Column:
    return F.concat(
        F.lower(first), F.lit("."), F.lower(last), number.cast("string"), F.lit("@"), domain
    )


def stock_code(brand: Column, number: Column) -> Column:
    """Three letters of the brand and a number, as in ``APP-12345``."""
    return F.concat(F.upper(F.substring(brand, 1, 3)), F.lit("-"), number.cast("string"))


def product_blurb(name: Column, brand: Column) -> Column:
    return F.concat(F.lit("High-quality "), name, F.lit(" from "), brand)


def size_label(length: Column, width: Column, height: Column) -> Column:
    return F.concat_ws("x", *[c.cast("string") for c in (length, width, height)])


def shorten(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def money_text(amount: Column) -> Column:
    """Thousands separators and two decimals."""
    return F.format_number(amount, 2)


def percent_text(value: Column) -> Column:
    """A number that is already a percentage, to one decimal."""
    return F.format_string("%.1f%%", value.cast("double"))


def fraction_text(value: Column) -> Column:
    """A fraction of 1 written as a percentage to one decimal."""
    return percent_text(value.cast("double") * 100)
