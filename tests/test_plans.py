"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pytest

from shop_data import AS_OF
from shoplytic.operators import churn, cohorts, customers, insights, kpis, products, revenue
from shoplytic.plans import churn as churn_model
from shoplytic.schema import SCHEMAS
from shoplytic.sources import tables, tpch

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shop"))
    for name in SCHEMAS:
        getattr(small, name).write.parquet(f"{root}/{name}")
    return tables.read_files(spark, root)


def read_columns(text: str, table: str) -> list[set[str]]:
    found = re.findall(rf"/{table}[^\n]*ReadSchema: struct<([^>]*)>", text)
    return [set(re.findall(r"(\w+):", columns)) for columns in found]


def test_status_filter_reaches_the_scan(stored):
    text = plan(revenue.revenue_trend(stored))
    assert "PushedFilters: [In(order_status, [confirmed,delivered,shipped])" in text
    assert read_columns(text, "orders") == [{"order_date", "order_status", "total_amount"}]


def test_date_filter_reaches_the_scan(stored):
    text = plan(insights.recent_monthly_revenue(stored, AS_OF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(order", text)


def test_kpis_read_each_table_once(stored):
    text = plan(kpis.kpi_summary(stored))
    assert len(read_columns(text, "orders")) == 1
    assert read_columns(text, "customers") == [set()]
    assert read_columns(text, "products") == [{"is_active"}]


def test_orders_shrink_before_they_meet_customers(stored):
    text = plan(customers.customer_spending(stored))
    assert text.index("Join") < text.index("sum(total_amount")
    assert len(read_columns(text, "orders")) == 1


def test_cohort_window_runs_on_distinct_months(stored):
    text = plan(cohorts.cohort_retention(stored))
    window = text.index("Window [min(activity_month")
    assert "HashAggregate(keys=[customer_id" in text[window:]


def test_lines_are_summed_before_the_catalogue(stored):
    text = plan(products.product_sales(stored))
    assert "LeftSemi" in text
    assert {"product_name"}.isdisjoint(*read_columns(text, "order_items"))
    assert read_columns(text, "orders") == [{"order_id", "order_status"}]


def test_no_plan_multiplies_rows_without_a_key(stored):
    frames = [
        customers.customer_ranking(stored),
        customers.top_customers(stored),
        products.product_performance(stored),
        products.product_quadrants(stored),
        churn.churn_features(stored, AS_OF),
        churn.churn_model_inputs(churn.churn_features(stored, AS_OF)),
        insights.business_insights(stored, AS_OF),
    ]
    for df in frames:
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_tier_codes_read_customers_only(stored):
    text = plan(churn.churn_model_inputs(churn.churn_features(stored, AS_OF)))
    subquery = text[text.index("Subquery") :]
    subquery = subquery[: subquery.index("order_items")]
    assert "collect_set(customer_tier" in subquery and "/customers" in subquery


def test_top_risk_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(10).selectExpr(
        "id AS customer_id", "'Gold' AS customer_tier", "id AS total_spent",
        "rand() AS churn_probability", "if(id > 5, 'High Risk', 'Low Risk') AS risk_level",
    )
    text = plan(churn_model.risk_top_customers(df))
    assert "WindowGroupLimit" in text


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")
def test_adapter_drops_what_a_query_does_not_ask_for(spark):
    t = tpch.load(spark, FOLDER)
    text = plan(revenue.revenue_trend(t))
    assert "lineitem" not in text
    assert "PushedFilters: [In(o_orderstatus, [F,P])" in text
    assert "orders.parquet" not in plan(t.customers.select("customer_id", "customer_tier"))
