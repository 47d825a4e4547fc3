from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shop_data import day
from shoplytic.functions import dates, labels, numeric


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("probability", "level"),
    [
        (0.0, None),
        (0.0001, "Low Risk"),
        (0.3, "Low Risk"),
        (0.30001, "Medium Risk"),
        (0.7, "Medium Risk"),
        (0.71, "High Risk"),
        (1.0, "High Risk"),
    ],
)
def test_risk_level(spark, probability, level):
    assert one(spark, labels.risk_level(F.lit(probability))) == (level,)


def test_ratios(spark):
    assert one(
        spark,
        numeric.ratio(F.lit(1), F.lit(0)),
        numeric.ratio(F.lit(1), F.lit(4)),
        numeric.ratio_or_zero(F.lit(1), F.lit(0)),
        numeric.ratio_or_zero(F.lit(1), F.lit(-2)),
        numeric.share_pct(F.lit(1), F.lit(3)),
        numeric.share_pct(F.lit(1), F.lit(0)),
        numeric.growth_pct(F.lit(110), F.lit(100)),
        numeric.growth_pct(F.lit(110), F.lit(0)),
    ) == (None, 0.25, 0.0, 0.0, 33.33, None, 10.0, None)


def test_as_number(spark):
    assert one(
        spark,
        numeric.as_number(F.lit("1.5")),
        numeric.as_number(F.lit("x")),
        numeric.as_number(F.lit(None).cast("string")),
    ) == (1.5, 0.0, 0.0)


def test_clamp(spark):
    assert one(spark, *[numeric.clamp(F.lit(v), 18, 80) for v in (5, 40, 99)]) == (18, 40, 80)


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.decimals(-(10**9), 10**9, places=2), st.integers(min_value=1, max_value=10**6)
        ),
        min_size=50,
        max_size=50,
    )
)
def test_quotient_to_cents_is_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "s decimal(28,2), n long")
    quotient = numeric.quotient_to_cents(F.col("s"), F.col("n"))
    for row in df.select("s", "n", quotient.alias("q")).collect():
        exact = (row["s"] / row["n"]).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert row["q"] == exact


def test_half_cents_round_away_from_zero(spark):
    values = [Decimal("0.01"), Decimal("-0.01"), Decimal("0.03")]
    df = spark.createDataFrame([(v, 2) for v in values], "s decimal(28,2), n long")
    got = [r[0] for r in df.select(numeric.quotient_to_cents(F.col("s"), F.col("n"))).collect()]
    assert got == [Decimal("0.01"), Decimal("-0.01"), Decimal("0.02")]


def test_dates(spark):
    sunday = dates.day(day("2024-12-29"))
    assert one(
        spark,
        dates.weekday_from_sunday(sunday),
        dates.weekday_from_monday(sunday),
        dates.month_start(sunday),
        dates.whole_months(dates.day(day("2025-02-01")), dates.day(day("2023-11-01"))),
    ) == (0, 6, day("2024-12-01"), 15)


def test_labels(spark):
    assert one(
        spark,
        labels.full_name(F.lit("Ann"), F.lit("Lee")),
        labels.email_address(F.lit("Ann"), F.lit("Lee"), F.lit(7), F.lit("x.org")),
        labels.stock_code(F.lit("Apple"), F.lit(12345)),
        labels.product_blurb(F.lit("Hat"), F.lit("Wool")),
        labels.size_label(F.lit(1), F.lit(2), F.lit(3)),
        labels.shorten(F.lit("abcdef"), 3),
        labels.money_text(F.lit(1234567.891)),
        labels.percent_text(F.lit(12.34)),
        labels.fraction_text(F.lit(0.1234)),
    ) == (
        "Ann Lee", "ann.lee7@x.org", "APP-12345", "High-quality Hat from Wool", "1x2x3", "abc",
        "1,234,567.89", "12.3%", "12.3%",
    )
