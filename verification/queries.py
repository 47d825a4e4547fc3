"""Every registered query: operators over the tables in a data folder."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplytic.operators import (
    affinity,
    churn,
    cohorts,
    customers,
    filters,
    insights,
    kpis,
    pricing,
    products,
    quality,
    revenue,
    sales,
    scaling,
    selection,
)
from shoplytic.plans import churn as churn_model
from shoplytic.plans import dashboard
from shoplytic.plans import forecast as forecast_model
from shoplytic.schema import Tables, valid_orders
from shoplytic.session import checkpoint_folder
from shoplytic.sources import tables as sources
from shoplytic.sources import layout, maintained, tpch, views
from verification import streams
from verification.model_parts import part_queries

AS_OF = tpch.AS_OF
UPDATED_AT = dt.datetime(2001, 8, 1)
YEAR_START, YEAR_END = dt.date(1996, 1, 1), dt.date(1996, 12, 1)
TIERS = ("BUILDING", "MACHINERY")
ALL_TIERS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CATEGORIES = ("PROMO", "SMALL")
BRAND = "Brand#1"
# Months from the first day that orders can have to AS_OF.
LAST_PERIOD = 79
LAST_YEAR = dt.date(2000, 8, 1)
TIER_RATES = {"BUILDING": "0.05", "MACHINERY": "0.10"}
TIER_SHARES = {"BUILDING": 20, "MACHINERY": 30}

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines return the same types."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def over_tables(operator: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(operator(tpch.load(spark, folder)))

    return run


def features(t: Tables, grain: str = "line") -> DataFrame:
    return churn.churn_features(t, AS_OF, grain=grain)


def revenue_by_status(t: Tables) -> DataFrame:
    return sources.query(
        t,
        """
        SELECT order_status, count(*) AS orders_count, sum(total_amount) AS revenue
        FROM orders WHERE order_date >= :since GROUP BY order_status
        """,
        {"since": dt.date(1998, 1, 1)},
    )


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round floating-point results that differ in their last bits by engine."""
    return df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


def linear_trend(t: Tables) -> DataFrame:
    trend = revenue.revenue_linear_trend(revenue.revenue_trend(t))
    return rounded(trend, trend_revenue=2, slope=4, intercept=2, r_squared=6)


def linear_forecast(t: Tables) -> DataFrame:
    return rounded(revenue.revenue_linear_forecast(revenue.revenue_trend(t)), predicted_revenue=2)


def combined_catalogue(t: Tables) -> DataFrame:
    """Three lists with their category names, the rest under a default."""
    named = products_with_category(t)
    lists = {
        "PROMO": named.filter(F.col("category_name") == "PROMO"),
        "SMALL": named.filter(F.col("category_name") == "SMALL"),
        "OTHER": named.filter(~F.col("category_name").isin("PROMO", "SMALL")),
    }
    plain_lists = {name: part.drop("category_name") for name, part in lists.items()}
    merged = pricing.combined_catalogue(plain_lists, t.categories, default="STANDARD")
    return merged.select("product_id", "product_name", "brand", "category_name")


def products_with_category(t: Tables) -> DataFrame:
    return t.products.join(t.categories, "category_id")


def catalogue_filtered(t: Tables) -> DataFrame:
    return filters.products_filtered(products.product_performance(t), CATEGORIES)


def repeat_buyers_by_id(t: Tables) -> DataFrame:
    """Ranked customers picked by a frame of ids: those with more than ten orders."""
    ids = customers.order_sums(t.orders).filter(F.col("total_orders") > 10)
    return filters.by_id(customers.customer_ranking(t), "customer_id", ids)


def appended_customers(t: Tables) -> DataFrame:
    """All tiers appended one after the other to a new table, read back."""
    target = f"{checkpoint_folder(t.customers.sparkSession)}/appended-{uuid.uuid4()}"
    columns = ["customer_tier", "customer_id"]
    for tier in ALL_TIERS:
        part = filters.customers_filtered(t.customers, [tier])
        sources.append(part, target, columns)
    sources.append(t.customers.filter("false"), target, columns)
    return t.customers.sparkSession.read.parquet(target)


def appended_once(t: Tables) -> DataFrame:
    """Every tier appended twice under one load id, as by a retry, and read back."""
    spark = t.customers.sparkSession
    target = f"{checkpoint_folder(spark)}/appended-{uuid.uuid4()}"
    columns = ["customer_tier", "customer_id"]
    for tier in (*ALL_TIERS, *ALL_TIERS):
        part = filters.customers_filtered(t.customers, [tier])
        sources.append_once(part, target, columns, f"load-{tier}")
    return sources.loaded(spark, target, "customer_tier string, customer_id long")


def _laid_out(t: Tables, by: str) -> Tables:
    """The tables with orders and lines in a layout by month or day."""
    spark = t.orders.sparkSession
    home = f"{checkpoint_folder(spark)}/layout-{uuid.uuid4()}"
    layout.write_orders(t, f"{home}/orders", by)
    layout.write_lines(t, f"{home}/lines", by)
    return replace(
        t,
        orders=layout.read_rows(spark, f"{home}/orders", t.orders.schema, by),
        order_items=layout.read_rows(spark, f"{home}/lines", t.order_items.schema, by),
    )


def pruned_monthly_revenue(t: Tables) -> DataFrame:
    """The trailing quarter from a layout by month: only its folders are read."""
    return insights.recent_monthly_revenue(_laid_out(t, layout.MONTH), AS_OF)


def pruned_tier_revenue(t: Tables) -> DataFrame:
    """Revenue of some tiers in the second quarters of a calendar, from their folders."""
    laid = _laid_out(t, layout.MONTH)
    months = laid.orders.select(layout.MONTH).distinct().filter(F.quarter(layout.MONTH) == 2)
    some = layout.in_tiers(layout.in_periods(laid.orders, months), TIERS)
    return (
        valid_orders(laid.with_orders(some))
        .groupBy(F.col(layout.TIER).alias("customer_tier"))
        .agg(F.count("*").alias("orders_count"), F.sum("total_amount").alias("revenue"))
    )


def _maintained(t: Tables) -> maintained.FeatureViews:
    """Views published over all but the last year, and again over everything."""
    spark = t.orders.sparkSession
    home = f"{checkpoint_folder(spark)}/views-{uuid.uuid4()}"
    views = maintained.FeatureViews(spark, f"{home}/views", layout.MONTH)
    last_year = F.col("order_date") >= F.lit(LAST_YEAR)
    for part in (t.with_orders(t.orders.filter(~last_year)), t.with_orders(t.orders.filter(last_year))):
        layout.write_orders(part, f"{home}/orders", layout.MONTH, "append")
        layout.write_lines(part, f"{home}/lines", layout.MONTH, "append")
        views.publish(
            replace(
                t,
                orders=layout.read_rows(spark, f"{home}/orders", t.orders.schema),
                order_items=layout.read_rows(spark, f"{home}/lines", t.order_items.schema),
            )
        )
    return views


def maintained_sales_features(t: Tables) -> DataFrame:
    return _maintained(t).daily_features()


def maintained_churn_features(t: Tables) -> DataFrame:
    return _maintained(t).customer_features(t.customers, AS_OF)


def profit_quartile_limits(t: Tables) -> DataFrame:
    return selection.quantile_limits(products.product_performance(t), "total_profit")


def churn_scaled_inputs(t: Tables) -> DataFrame:
    """The model's inputs standardised over all customers."""
    inputs = churn.churn_model_inputs(features(t))
    scaled = scaling.fit_scaling(inputs, churn.MODEL_COLUMNS).apply(inputs)
    scaled = rounded(scaled, **dict.fromkeys(churn.MODEL_COLUMNS, 6))
    return scaled.withColumns({c: F.col(c) + 0.0 for c in churn.MODEL_COLUMNS})  # no -0.0


def sql_over_views(t: Tables) -> DataFrame:
    """Lifetime value by tier, asked in SQL of the registered feature view."""
    views.register_views(t, AS_OF)
    return t.customers.sparkSession.sql(
        """
        SELECT customer_tier, count(*) AS customers,
               cast(sum(total_spent) AS double) / count(*) AS avg_clv,
               cast(sum(days_since_last_order) AS double) / count(*) AS avg_recency,
               cast(sum(orders_last_90_days) AS double) / count(*) AS recent_activity
        FROM customer_ml_features GROUP BY customer_tier
        """
    )


def recent_months(t: Tables) -> DataFrame:
    return insights.recent_monthly_revenue(t, AS_OF)


def sql_queries() -> dict[str, Query]:
    """Queries with an exact SQL counterpart."""
    operators: dict[str, Callable[[Tables], DataFrame]] = {
        "kpi_summary": kpis.kpi_summary,
        "customer_ranking": customers.customer_ranking,
        "tier_summary": customers.tier_summary,
        "paying_in_tier": lambda t: customers.paying_in_tier(t, TIERS[0]),
        "tier_distribution": customers.tier_distribution,
        "top_customers": customers.top_customers,
        "top_customer_concentration": customers.top_customer_concentration,
        "top_spenders": customers.top_spenders,
        "top_spenders_summary": customers.top_spenders_summary,
        "order_activity": lambda t: customers.order_activity(t, AS_OF),
        "customers_filtered": lambda t: filters.customers_filtered(
            customers.customer_ranking(t), TIERS
        ),
        "revenue_trend": revenue.revenue_trend,
        "revenue_filtered": lambda t: filters.revenue_filtered(
            revenue.revenue_trend(t), YEAR_START, YEAR_END
        ),
        "revenue_status": lambda t: revenue.revenue_status(revenue.revenue_trend(t)),
        "revenue_linear_trend": linear_trend,
        "revenue_linear_forecast": linear_forecast,
        "revenue_by_status": revenue_by_status,
        "cohort_retention": cohorts.cohort_retention,
        "cohort_matrix": lambda t: cohorts.cohort_matrix(cohorts.cohort_retention(t), LAST_PERIOD),
        "product_performance": products.product_performance,
        "product_quartiles": products.product_quartiles,
        "products_filtered": catalogue_filtered,
        "category_summary": products.category_summary,
        "top_products": products.top_products,
        "brand_share": lambda t: products.brand_share(t, BRAND),
        "above_median_profit": products.above_median_profit,
        "product_quadrants": products.product_quadrants,
        "product_bubbles": lambda t: products.product_quadrants(t, 30),
        "product_affinity": affinity.product_affinity,
        "filter_domains": products.filter_domains,
        "daily_sales": sales.daily_sales,
        "daily_sales_by_payment": lambda t: sales.daily_sales(t, ["payment_method"]),
        "sales_features": lambda t: sales.sales_features(sales.daily_sales(t)),
        "sales_features_lagged": lambda t: sales.sales_features(
            sales.daily_sales(t), lagged=True
        ),
        "churn_features": features,
        "churn_features_order": lambda t: features(t, "order"),
        "churn_features_at_horizon": lambda t: churn.churn_features_at_horizon(t, AS_OF),
        "churn_model_inputs": lambda t: churn.churn_model_inputs(features(t)),
        "churn_dataset_summary": lambda t: churn.churn_dataset_summary(features(t)),
        "clv_by_tier": lambda t: churn.clv_by_tier(features(t, "order")),
        "retention_alert_count": lambda t: churn.retention_alert_count(features(t, "order")),
        "revenue_trend_signal": lambda t: insights.revenue_trend_signal(t, AS_OF),
        "business_insights": lambda t: insights.business_insights(t, AS_OF),
        "dashboard_payload": lambda t: dashboard.dashboard_payload(t, UPDATED_AT),
        "order_totals": lambda t: pricing.order_totals(
            t, tier_rates=TIER_RATES, tier_shares=TIER_SHARES
        ),
        "product_labels": pricing.product_labels,
        "customer_labels": pricing.customer_labels,
        "combined_catalogue": combined_catalogue,
        "quality_report": quality.quality_report,
        "kpi_texts": kpis.kpi_texts,
        "customer_spending": customers.customer_spending,
        "top_customer": lambda t: customers.top_customers(t, 1),
        "chosen_top_customers": lambda t: customers.chosen_top_customers(t, 25),
        "chosen_top_products": lambda t: products.chosen_top_products(t, 25),
        "star_product": lambda t: products.top_products(t, 1),
        "repeat_buyers_by_id": repeat_buyers_by_id,
        "products_of_brand": lambda t: filters.one_of(
            products.product_performance(t), "brand", [BRAND]
        ),
        "order_lines": products.order_lines,
        "recent_monthly_revenue": recent_months,
        "at_risk_customers": lambda t: churn.at_risk(features(t, "order")),
        "sales_features_by_payment": lambda t: sales.sales_features(
            sales.daily_sales(t, ["payment_method"]), ["payment_method"]
        ),
        "appended_customers": appended_customers,
        "appended_once": appended_once,
        "pruned_monthly_revenue": pruned_monthly_revenue,
        "pruned_tier_revenue": pruned_tier_revenue,
        "maintained_sales_features": maintained_sales_features,
        "maintained_churn_features": maintained_churn_features,
        "profit_quartile_limits": profit_quartile_limits,
        "churn_scaled_inputs": churn_scaled_inputs,
        "sql_over_views": sql_over_views,
    }
    runs = {name: over_tables(operator) for name, operator in operators.items()}
    for stream in (
        streams.stream_daily_sales,
        streams.stream_running_totals,
        streams.stream_first_arrivals,
        streams.stream_insert_once,
        streams.stream_late_days,
        streams.stream_exact_totals,
        streams.stream_sales_features,
        streams.stream_sales_features_by_payment,
    ):
        runs[stream.__name__] = _plain_stream(stream)
    return runs


def _plain_stream(stream: Query) -> Query:
    return lambda spark, folder: plain(stream(spark, folder))


# A model is trained once per session and state of the data, and used by all its queries.
_models: dict[tuple, tuple[PipelineModel, DataFrame]] = {}
MODEL_TABLES = ("customer", "orders", "lineitem")


def forget_models() -> None:
    """Train anew from here on."""
    _models.clear()


def _state(spark: SparkSession, folder: str) -> tuple:
    """The files that models are trained on, with their sizes and times of change."""
    files = []
    for name in MODEL_TABLES:
        about = tpch.table(spark, folder, name).select(
            "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
        )
        files += [tuple(r) for r in about.distinct().collect()]
    return tuple(sorted(files))


def _trained(kind: str, spark: SparkSession, folder: str, train) -> tuple:
    key = (kind, spark.sparkContext.applicationId, _state(spark, folder))
    if key not in _models:
        _models[key] = train()
    return _models[key]


def _churn(spark: SparkSession, folder: str, at_horizon: bool = False):
    t = tpch.load(spark, folder)
    training = churn.churn_features_at_horizon(t, AS_OF) if at_horizon else features(t)
    model, metrics = _trained(
        f"churn-{at_horizon}", spark, folder, lambda: churn_model.train_churn(training)
    )
    return model, metrics, features(t)


def _predictions(spark: SparkSession, folder: str, at_horizon: bool) -> DataFrame:
    model, _, current = _churn(spark, folder, at_horizon)
    return churn_model.score_churn(model, current)


def _forecast(spark: SparkSession, folder: str):
    inputs = sales.sales_features(sales.daily_sales(tpch.load(spark, folder)))
    model, metrics = _trained(
        "forecast", spark, folder, lambda: forecast_model.train_forecast(inputs)
    )
    return model, metrics, inputs


def churn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.most_likely_first(_predictions(spark, folder, False))


def churn_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _churn(spark, folder)[1]


def churn_feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.feature_importance(_churn(spark, folder)[0])


def churn_predictions_at_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.most_likely_first(_predictions(spark, folder, True))


def churn_predictions_reloaded(spark: SparkSession, folder: str) -> DataFrame:
    """The same predictions from a model saved and loaded again."""
    model, _, current = _churn(spark, folder)
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4()}"
    churn_model.save_model(model, path)
    return churn_model.score_churn(churn_model.load_model(path), current)


def risk_summary(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.risk_summary(_predictions(spark, folder, True))


def risk_top_customers(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.risk_top_customers(_predictions(spark, folder, True))


def risk_points(spark: SparkSession, folder: str) -> DataFrame:
    return churn_model.risk_points(_predictions(spark, folder, True))


def sales_forecast(spark: SparkSession, folder: str) -> DataFrame:
    model, _, inputs = _forecast(spark, folder)
    return forecast_model.sales_forecast(model, inputs)


def _forecast_by_payment(spark: SparkSession, folder: str):
    series = ["payment_method"]
    daily = sales.daily_sales(tpch.load(spark, folder), series)
    inputs = sales.sales_features(daily, series)
    model, metrics = _trained(
        "forecast-by-payment",
        spark,
        folder,
        lambda: forecast_model.train_forecast(inputs, series),
    )
    return model, metrics, inputs


def sales_forecast_by_payment(spark: SparkSession, folder: str) -> DataFrame:
    model, _, inputs = _forecast_by_payment(spark, folder)
    return forecast_model.sales_forecast(model, inputs, series=["payment_method"])


def forecast_metrics_by_payment(spark: SparkSession, folder: str) -> DataFrame:
    return _forecast_by_payment(spark, folder)[1]


def forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _forecast(spark, folder)[1]


def model_queries() -> dict[str, Query]:
    """Queries on fitted models: no SQL counterpart."""
    return {
        "churn_metrics": churn_metrics,
        "churn_feature_importance": churn_feature_importance,
        "churn_predictions": churn_predictions,
        "churn_predictions_reloaded": churn_predictions_reloaded,
        "churn_predictions_at_horizon": churn_predictions_at_horizon,
        "risk_summary": risk_summary,
        "risk_top_customers": risk_top_customers,
        "risk_points": risk_points,
        "forecast_metrics": forecast_metrics,
        "sales_forecast": sales_forecast,
        "forecast_metrics_by_payment": forecast_metrics_by_payment,
        "sales_forecast_by_payment": sales_forecast_by_payment,
    }


def all_queries() -> dict[str, Query]:
    return {**sql_queries(), **part_queries(), **model_queries()}
