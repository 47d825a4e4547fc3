"""DuckDB SQL for every query of ``sql_queries``, written from the definitions.

The shop's tables are CTEs over the raw tables. Aggregates run on decimals and
are cast to DOUBLE at the end, as the queries do.
"""

from __future__ import annotations

from shoplytic.operators.churn import MODEL_COLUMNS
from verification.model_parts import part_oracles

SHOP = """
shop_items AS (
    SELECT CAST(l_linenumber AS BIGINT) AS order_item_id,
           l_orderkey AS order_id,
           l_partkey AS product_id,
           CAST(l_quantity AS INTEGER) AS quantity,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2))
                * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(22,4)) AS line_total,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2))
                * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(22,4)) AS discount_applied
    FROM lineitem
),
shop_orders AS (
    SELECT o_orderkey AS order_id,
           o_custkey AS customer_id,
           CAST(o_orderdate AS DATE) AS order_date,
           o_orderstatus AS order_status,
           o_orderpriority AS payment_method,
           CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
           COALESCE(s.subtotal, 0) AS subtotal,
           COALESCE(s.discount_amount, 0) AS discount_amount
    FROM orders
    LEFT JOIN (
        SELECT order_id, SUM(line_total) AS subtotal, SUM(discount_applied) AS discount_amount
        FROM shop_items GROUP BY order_id
    ) s ON s.order_id = o_orderkey
),
shop_customers AS (
    SELECT c_custkey AS customer_id,
           split_part(c_name, '#', 1) AS first_name,
           split_part(c_name, '#', 2) AS last_name,
           c_mktsegment AS customer_tier,
           COALESCE(r.registration_date, DATE '1995-01-01') AS registration_date
    FROM customer
    LEFT JOIN (
        SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS registration_date
        FROM orders GROUP BY o_custkey
    ) r ON r.o_custkey = c_custkey
),
shop_products AS (
    SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name,
           p_brand AS brand, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_cost,
           p_size % 4 <> 0 AS is_active
    FROM part
),
valid_orders AS (
    SELECT * FROM shop_orders WHERE order_status IN ('F', 'P')
)"""

SPENDING = """
spending AS (
    SELECT c.customer_id, c.first_name, c.last_name, c.customer_tier, c.registration_date,
           COUNT(o.order_id) AS total_orders,
           COALESCE(SUM(o.total_amount), 0) AS total_spent
    FROM shop_customers c
    LEFT JOIN shop_orders o
      ON c.customer_id = o.customer_id AND o.order_status IN ('F', 'P')
    GROUP BY ALL
),
paying AS (
    SELECT customer_id, first_name, last_name, customer_tier, total_orders,
           CAST(total_spent AS DOUBLE) AS total_spent,
           ROW_NUMBER() OVER (ORDER BY total_spent DESC, customer_id) AS overall_rank,
           RANK() OVER (PARTITION BY customer_tier ORDER BY total_spent DESC) AS rank_in_tier,
           ROUND(CAST(total_spent AS DOUBLE) * 100.0
                 / NULLIF(CAST(SUM(total_spent) OVER () AS DOUBLE), 0), 2)
               AS pct_of_total_revenue
    FROM spending WHERE total_spent > 0
)"""

MONTHS = """
months AS (
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
           COUNT(*) AS orders_count, SUM(total_amount) AS revenue
    FROM valid_orders GROUP BY 1
),
trend AS (
    SELECT month, orders_count,
           CAST(revenue AS DOUBLE) AS monthly_revenue,
           CAST(SUM(revenue) OVER (ORDER BY month) AS DOUBLE) AS cumulative_revenue,
           CAST(LAG(revenue) OVER (ORDER BY month) AS DOUBLE) AS prev_month_revenue,
           ROUND(CAST(revenue - LAG(revenue) OVER (ORDER BY month) AS DOUBLE) * 100.0
                 / NULLIF(CAST(LAG(revenue) OVER (ORDER BY month) AS DOUBLE), 0), 1)
               AS mom_growth_pct
    FROM months
)"""


def _cents(numerator: str, count: str) -> str:
    """Exact quotient of a decimal and a count, to two decimals, half away from zero."""
    units = f"CAST(ABS({numerator}) * 10000 AS HUGEINT)"
    whole = f"((2 * {units} + 100 * CAST({count} AS HUGEINT)) // (200 * CAST({count} AS HUGEINT)))"
    return f"(CASE WHEN {numerator} < 0 THEN -1 ELSE 1 END * {whole})"


def _money(cents: str) -> str:
    """Whole hundredths as text with thousands separators and two decimals."""
    whole, rest = f"CAST({cents} // 100 AS BIGINT)", f"CAST({cents} % 100 AS BIGINT)"
    return f"format('{{:,}}', {whole}) || '.' || format('{{:02d}}', {rest})"


_MARGIN = "(SUM(i.unit_price) - p.unit_cost * COUNT(i.unit_price))"
_PROFIT = f"CAST({_MARGIN} AS DECIMAL(24,2)) * CAST(SUM(i.quantity) AS DECIMAL(10,0))"

PERFORMANCE = f"""
sold AS (
    SELECT p.product_id, p.product_name, p.brand, p.category_name,
           COUNT(i.order_item_id) AS times_ordered,
           CAST(SUM(i.quantity) AS BIGINT) AS total_units_sold,
           SUM(i.line_total) AS revenue,
           CAST(ROUND(SUM(i.line_total), 2) AS DECIMAL(24,2)) AS total_revenue,
           {_cents("SUM(i.unit_price)", "COUNT(i.unit_price)")} AS price_cents,
           {_cents(_MARGIN, "COUNT(i.unit_price)")} AS profit_cents,
           {_cents(_PROFIT, "COUNT(i.unit_price)")} AS total_profit_cents
    FROM shop_products p
    JOIN shop_items i ON i.product_id = p.product_id
    JOIN shop_orders o ON o.order_id = i.order_id
    WHERE o.order_status IN ('F', 'P')
    GROUP BY p.product_id, p.product_name, p.brand, p.category_name, p.unit_cost
),
report AS (
    SELECT product_id, product_name, brand, category_name, times_ordered, total_units_sold,
           CAST(total_revenue AS DOUBLE) AS total_revenue,
           CAST(price_cents AS DOUBLE) / 100 AS avg_selling_price,
           CAST(profit_cents AS DOUBLE) / 100 AS profit_per_unit,
           CAST(total_profit_cents AS DOUBLE) / 100 AS total_profit,
           RANK() OVER (ORDER BY revenue DESC) AS revenue_rank,
           ROUND(CAST(revenue AS DOUBLE) * 100.0
                 / NULLIF(CAST(SUM(revenue) OVER () AS DOUBLE), 0), 2) AS pct_of_total_revenue
    FROM sold
)"""

REPORT_COLUMNS = (
    "product_id, product_name, brand, category_name, times_ordered, total_units_sold, "
    "total_revenue, avg_selling_price, profit_per_unit, total_profit"
)

COHORTS = """
firsts AS (
    SELECT customer_id, date_trunc('month', MIN(order_date)) AS cohort
    FROM valid_orders GROUP BY customer_id
),
activity AS (
    SELECT CAST(f.cohort AS DATE) AS cohort_month,
           CAST(date_diff('month', f.cohort, date_trunc('month', o.order_date)) AS INTEGER)
               AS period_number,
           COUNT(DISTINCT f.customer_id) AS active_customers
    FROM firsts f JOIN valid_orders o ON o.customer_id = f.customer_id
    GROUP BY 1, 2
),
retention AS (
    SELECT cohort_month, period_number, active_customers,
           ROUND(active_customers * 100.0 / FIRST_VALUE(active_customers) OVER (
               PARTITION BY cohort_month ORDER BY period_number ROWS UNBOUNDED PRECEDING), 1)
               AS retention_rate
    FROM activity
)"""


def _daily(series: str = "") -> str:
    lead = f"{series}, " if series else ""
    return f"""
daily AS (
    SELECT {lead}order_date AS sales_date, COUNT(*) AS order_count,
           SUM(total_amount) AS revenue,
           CAST(SUM(total_amount) AS DOUBLE) AS daily_revenue,
           CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value,
           COUNT(DISTINCT customer_id) AS unique_customers,
           CAST(EXTRACT(DOW FROM order_date) AS INTEGER) AS day_of_week,
           CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month
    FROM valid_orders GROUP BY {lead}order_date
)"""


def _lag(k: int, by: str) -> str:
    return f"CAST(LAG(revenue, {k}) OVER ({by}) AS DOUBLE)"


def _trailing(k: int, by: str) -> str:
    frame = f"({by} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN COUNT(revenue) OVER {frame} = {k} "
        f"THEN CAST(SUM(revenue) OVER {frame} AS DOUBLE) / {k} END"
    )


def _sales_features(lagged: bool, series: str = "") -> str:
    by = f"PARTITION BY {series} ORDER BY sales_date" if series else "ORDER BY sales_date"
    lead = f"{series}, " if series else ""
    ma, trend = "ma_7", "daily_revenue / NULLIF(ma_7, 0)"
    if lagged:
        ma = f"LAG({ma}) OVER ({by})"
        trend = f"LAG({trend}) OVER ({by})"
    return f"""
WITH {SHOP}, {_daily(series)},
wide AS (
    SELECT *,
           {", ".join(f"{_lag(k, by)} AS revenue_lag_{k}" for k in (1, 7, 14, 30))},
           {_trailing(7, by)} AS ma_7,
           {_trailing(30, by)} AS revenue_ma_30,
           CASE WHEN day_of_week IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
           CASE WHEN EXTRACT(DAY FROM sales_date) <= 5 THEN 1 ELSE 0 END AS is_month_start,
           CASE WHEN EXTRACT(DAY FROM sales_date) >= 25 THEN 1 ELSE 0 END AS is_month_end
    FROM daily
),
full_rows AS (
    SELECT {lead}sales_date, order_count, daily_revenue, avg_order_value, unique_customers,
           day_of_week, month, revenue_lag_1, revenue_lag_7, revenue_lag_14, revenue_lag_30,
           {ma} AS revenue_ma_7, revenue_ma_30, {trend} AS revenue_trend_7,
           daily_revenue / NULLIF(revenue_lag_1, 0) - 1 AS revenue_growth,
           is_weekend, is_month_start, is_month_end
    FROM wide
)
SELECT * FROM full_rows
WHERE revenue_lag_30 IS NOT NULL AND revenue_ma_7 IS NOT NULL AND revenue_ma_30 IS NOT NULL
  AND revenue_trend_7 IS NOT NULL AND revenue_growth IS NOT NULL
"""


def _churn_features(grain: str, as_of: str = "2001-08-01", only_until: bool = False) -> str:
    """The features as one join; the line grain lets the line join multiply orders."""
    today = f"DATE '{as_of}'"
    until = f" AND o.order_date <= {today}" if only_until else ""
    lines = "LEFT JOIN shop_items i ON i.order_id = o.order_id" if grain == "line" else ""
    distinct_products = (
        "COUNT(DISTINCT i.product_id)"
        if grain == "line"
        else "COALESCE(MAX(u.unique_products), 0)"
    )
    counted = (
        ""
        if grain == "line"
        else """LEFT JOIN (
        SELECT v.customer_id, COUNT(DISTINCT i.product_id) AS unique_products
        FROM valid_orders v JOIN shop_items i ON i.order_id = v.order_id
        GROUP BY v.customer_id) u ON u.customer_id = c.customer_id"""
    )
    return f"""
churn AS (
    SELECT c.customer_id, c.customer_tier,
           CAST({today} - c.registration_date AS INTEGER) AS days_since_registration,
           COUNT(o.order_id) AS total_orders,
           CAST(COALESCE(SUM(o.total_amount), 0) AS DOUBLE) AS total_spent,
           COALESCE(CAST(SUM(o.total_amount) AS DOUBLE) / NULLIF(COUNT(o.total_amount), 0), 0)
               AS avg_order_value,
           COALESCE(MAX(o.order_date), c.registration_date) AS last_order_date,
           CAST({today} - COALESCE(MAX(o.order_date), c.registration_date) AS INTEGER)
               AS days_since_last_order,
           COUNT(CASE WHEN o.order_date >= {today} - 90 THEN 1 END) AS orders_last_90_days,
           CAST(COALESCE(SUM(CASE WHEN o.order_date >= {today} - 90 THEN o.total_amount END), 0)
                AS DOUBLE) AS spent_last_90_days,
           {distinct_products} AS unique_products,
           COUNT(DISTINCT o.payment_method) AS payment_methods_used,
           COUNT(CASE WHEN o.discount_amount > 0 THEN 1 END) AS discount_orders,
           COALESCE(
               CAST(SUM(CASE WHEN o.discount_amount > 0 THEN o.discount_amount END) AS DOUBLE)
               / NULLIF(COUNT(CASE WHEN o.discount_amount > 0 THEN 1 END), 0), 0)
               AS avg_discount_used,
           CASE WHEN MAX(o.order_date) < {today} - 120 OR MAX(o.order_date) IS NULL
                THEN 1 ELSE 0 END AS is_churned
    FROM shop_customers c
    LEFT JOIN shop_orders o
      ON o.customer_id = c.customer_id AND o.order_status IN ('F', 'P'){until}
    {lines}
    {counted}
    GROUP BY c.customer_id, c.customer_tier, c.registration_date
    HAVING {today} - c.registration_date >= 30
)"""


_AT_RISK = (
    "days_since_last_order > 90 AND total_orders > 2 AND days_since_last_order < 365"
)

SIGNAL = """
recent AS (
    SELECT date_trunc('month', order_date) AS m, SUM(total_amount) AS revenue
    FROM valid_orders WHERE order_date >= DATE '2001-08-01' - INTERVAL 3 MONTH GROUP BY 1
),
pairs AS (
    SELECT CAST(m AS DATE) AS month, CAST(revenue AS DOUBLE) AS monthly_revenue,
           CAST(LAG(revenue) OVER (ORDER BY m) AS DOUBLE) AS previous_revenue,
           CAST(revenue - LAG(revenue) OVER (ORDER BY m) AS DOUBLE)
               / NULLIF(CAST(LAG(revenue) OVER (ORDER BY m) AS DOUBLE), 0) * 100 AS growth_rate,
           ROW_NUMBER() OVER (ORDER BY m DESC) AS newest
    FROM recent
),
signal AS (
    SELECT month, monthly_revenue, previous_revenue, growth_rate,
           CASE WHEN growth_rate > 10 THEN 'growth' WHEN growth_rate < -10 THEN 'decline' END
               AS signal
    FROM pairs WHERE newest = 1 AND previous_revenue IS NOT NULL
)"""

_LINE = """
points AS (
    SELECT month, CAST(month - MIN(month) OVER () AS INTEGER) AS day_offset, monthly_revenue
    FROM trend
),
line AS (
    SELECT regr_slope(monthly_revenue, day_offset) AS slope,
           regr_intercept(monthly_revenue, day_offset) AS intercept,
           regr_r2(monthly_revenue, day_offset) AS r_squared,
           MIN(month) AS first_month, MAX(month) AS last_month
    FROM points HAVING COUNT(*) >= 3
)"""

_QUADRANTS = f"""
medians AS (
    SELECT median(total_units_sold) AS median_units, median(profit_per_unit) AS median_profit
    FROM report
),
quadrants AS (
    SELECT {REPORT_COLUMNS}, median_units, median_profit,
           (CASE WHEN total_units_sold >= median_units THEN 'High' ELSE 'Low' END)
           || ' Volume / '
           || (CASE WHEN profit_per_unit >= median_profit THEN 'High' ELSE 'Low' END)
           || ' Profit' AS quadrant
    FROM report, medians
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


def _rule(table: str, rule: str, violations: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{rule}' AS rule, "
        f"CAST(({violations}) AS BIGINT) AS violations"
    )


_RULES = " UNION ALL ".join(
    [
        _rule("order_items", "line_total_matches",
              "SELECT COUNT(*) FROM shop_items "
              "WHERE line_total <> quantity * unit_price - discount_applied"),
        _rule("order_items", "quantity_positive",
              "SELECT COUNT(*) FROM shop_items WHERE quantity <= 0"),
        _rule("orders", "total_matches",
              "SELECT COUNT(*) FROM shop_orders WHERE total_amount <> subtotal - discount_amount"),
        _rule("orders", "status_known",
              "SELECT COUNT(*) FROM shop_orders WHERE order_status NOT IN ('F', 'P', 'O')"),
        _rule("orders", "subtotal_matches",
              "SELECT COUNT(*) FROM shop_orders o LEFT JOIN (SELECT order_id, SUM(line_total) AS s "
              "FROM shop_items GROUP BY order_id) l ON l.order_id = o.order_id "
              "WHERE o.subtotal <> COALESCE(l.s, 0)"),
        _rule("customers", "tier_known",
              "SELECT COUNT(*) FROM shop_customers WHERE customer_tier NOT IN "
              "('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
        _rule("orders", "customer_exists",
              "SELECT COUNT(*) FROM shop_orders WHERE customer_id NOT IN "
              "(SELECT customer_id FROM shop_customers)"),
        _rule("order_items", "order_exists",
              "SELECT COUNT(*) FROM shop_items WHERE order_id NOT IN "
              "(SELECT order_id FROM shop_orders)"),
        _rule("order_items", "product_exists",
              "SELECT COUNT(*) FROM shop_items WHERE product_id NOT IN "
              "(SELECT product_id FROM shop_products)"),
        _rule("products", "category_exists",
              "SELECT COUNT(*) FROM shop_products WHERE category_name IS NULL"),
        _rule("customer_addresses", "customer_exists",
              "SELECT COUNT(*) FROM customer a LEFT JOIN shop_customers c "
              "ON c.customer_id = a.c_custkey WHERE c.customer_id IS NULL"),
        _rule("customer_addresses", "one_primary_address",
              "SELECT COUNT(*) FROM (SELECT c_custkey FROM customer "
              "GROUP BY c_custkey HAVING COUNT(*) <> 1)"),
    ]
)


def oracle_sql() -> dict[str, str]:
    base = _with(SHOP)
    spending = _with(SHOP, SPENDING)
    trend = _with(SHOP, MONTHS)
    performance = _with(SHOP, PERFORMANCE)
    order_features = _with(SHOP, _churn_features("order"))
    line_features = _with(SHOP, _churn_features("line"))
    horizon = _churn_features("line", "2001-04-03", only_until=True)
    daily_sales = f"""{_with(SHOP, _daily())}
        SELECT sales_date, order_count, daily_revenue, avg_order_value, unique_customers
        FROM daily"""
    valid_rows = f"""{base}
        SELECT order_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, order_date
        FROM valid_orders"""
    periods = ", ".join(
        f"MAX(CASE WHEN period_number = {p} THEN retention_rate END) AS period_{p}"
        for p in range(80)
    )
    recent_months = f"""{base}
        SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
               COUNT(*) AS orders_count,
               CAST(SUM(total_amount) AS DOUBLE) AS monthly_revenue
        FROM valid_orders WHERE order_date >= DATE '2001-08-01' - INTERVAL 3 MONTH
        GROUP BY 1"""
    model_inputs = f"""{line_features}
        SELECT customer_id,
               CAST(DENSE_RANK() OVER (ORDER BY customer_tier) - 1 AS DOUBLE)
                   AS customer_tier_encoded,
               CAST(days_since_registration AS DOUBLE) AS days_since_registration,
               CAST(total_orders AS DOUBLE) AS total_orders,
               total_spent, avg_order_value,
               CAST(days_since_last_order AS DOUBLE) AS days_since_last_order,
               CAST(orders_last_90_days AS DOUBLE) AS orders_last_90_days,
               spent_last_90_days,
               CAST(unique_products AS DOUBLE) AS unique_products,
               CAST(payment_methods_used AS DOUBLE) AS payment_methods_used,
               CAST(discount_orders AS DOUBLE) AS discount_orders,
               avg_discount_used,
               CASE WHEN days_since_registration > 0 THEN CAST(total_orders AS DOUBLE)
                    / (CAST(days_since_registration AS DOUBLE) / 30.0) ELSE 0 END
                   AS order_frequency,
               CASE WHEN total_orders > 0 THEN CAST(orders_last_90_days AS DOUBLE)
                    / CAST(total_orders AS DOUBLE) ELSE 0 END AS recent_activity_ratio,
               CASE WHEN days_since_registration > 0 THEN total_spent
                    / CAST(days_since_registration AS DOUBLE) ELSE 0 END AS spending_per_day,
               is_churned
        FROM churn"""
    scaled = ", ".join(
        f"round(({c} - AVG({c}) OVER ()) / CASE WHEN STDDEV_POP({c}) OVER () = 0 THEN 1 "
        f"ELSE STDDEV_POP({c}) OVER () END, 6) + 0.0 AS {c}"
        for c in MODEL_COLUMNS
    )
    top_customers = """
        SELECT customer_id, first_name || ' ' || last_name AS customer_name, customer_tier,
               total_orders, total_spent, pct_of_total_revenue
        FROM paying ORDER BY total_spent DESC, customer_id"""
    top_spenders = """
        SELECT customer_id, customer_tier, registration_date, total_orders,
               CAST(total_spent AS DOUBLE) AS total_spent
        FROM spending ORDER BY total_spent DESC, customer_id LIMIT 10"""
    trend_columns = (
        "month, orders_count, monthly_revenue, cumulative_revenue, prev_month_revenue, "
        "mom_growth_pct"
    )
    return {
        "kpi_summary": f"""{base}
            SELECT (SELECT COUNT(*) FROM shop_customers) AS total_customers,
                   (SELECT COUNT(*) FROM valid_orders) AS total_orders,
                   (SELECT COUNT(*) FROM shop_products WHERE is_active) AS active_products,
                   (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) FROM valid_orders)
                       AS total_revenue,
                   (SELECT COALESCE(CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount), 0)
                    FROM valid_orders) AS avg_order_value,
                   (SELECT COUNT(DISTINCT customer_id) FROM valid_orders) AS active_customers""",
        "customer_ranking": f"{spending} SELECT * FROM paying",
        "customers_filtered": f"""{spending}
            SELECT * FROM paying WHERE customer_tier IN ('BUILDING', 'MACHINERY')""",
        "tier_summary": f"""{spending}
            SELECT customer_tier, COUNT(*) AS customers,
                   CAST(SUM(total_spent) AS DOUBLE) AS total_spent,
                   CAST(SUM(total_orders) AS BIGINT) AS total_orders
            FROM spending WHERE total_spent > 0 GROUP BY customer_tier""",
        "paying_in_tier": f"""{spending}
            SELECT COUNT(*) AS customers FROM paying WHERE customer_tier = 'BUILDING'""",
        "tier_distribution": f"""{base}
            SELECT customer_tier, COUNT(*) AS customer_count
            FROM shop_customers GROUP BY customer_tier""",
        "top_customers": f"{spending} {top_customers} LIMIT 20",
        "top_customer_concentration": f"""{spending}
            SELECT COUNT(*) AS customers,
                   CAST(SUM(CAST(pct_of_total_revenue AS DECIMAL(12,2))) AS DOUBLE) AS top_n_pct
            FROM ({top_customers} LIMIT 10) HAVING COUNT(*) = 10""",
        "top_spenders": f"{spending} {top_spenders}",
        "top_spenders_summary": f"""{spending}
            SELECT COUNT(*) AS customers, MAX(total_spent) AS highest_spent,
                   MAX(total_orders) AS most_orders FROM ({top_spenders})""",
        "order_activity": f"""{base}
            SELECT c.customer_id, c.customer_tier,
                   CAST(DATE '2001-08-01' - c.registration_date AS INTEGER)
                       AS days_since_registration,
                   COUNT(o.order_id) AS total_orders
            FROM shop_customers c LEFT JOIN shop_orders o ON o.customer_id = c.customer_id
            GROUP BY c.customer_id, c.customer_tier, c.registration_date
            ORDER BY c.customer_id LIMIT 5""",
        "revenue_trend": f"{trend} SELECT {trend_columns} FROM trend",
        "revenue_filtered": f"""{trend} SELECT {trend_columns} FROM trend
            WHERE month BETWEEN DATE '1996-01-01' AND DATE '1996-12-01'""",
        "revenue_status": f"""{trend}
            SELECT month, monthly_revenue, mom_growth_pct,
                   CASE WHEN mom_growth_pct > 10 THEN 'Strong growth'
                        WHEN mom_growth_pct < -10 THEN 'Revenue decline'
                        WHEN mom_growth_pct IS NOT NULL THEN 'Stable growth' END AS status,
                   cumulative_revenue
            FROM trend ORDER BY month DESC LIMIT 1""",
        "revenue_linear_trend": f"""{_with(SHOP, MONTHS, _LINE)}
            SELECT month, day_offset, monthly_revenue,
                   ROUND(slope * day_offset + intercept, 2) AS trend_revenue,
                   ROUND(slope, 4) AS slope, ROUND(intercept, 2) AS intercept,
                   ROUND(r_squared, 6) AS r_squared
            FROM points, line""",
        "revenue_linear_forecast": f"""{_with(SHOP, MONTHS, _LINE)},
            ends AS (
                SELECT *, last_day(CAST(date_trunc('month', last_month + 30)
                                   + to_months(CAST(k AS INTEGER)) AS DATE)) AS forecast_date
                FROM line, range(3) AS steps(k)
            )
            SELECT forecast_date,
                   ROUND(slope * (forecast_date - first_month) + intercept, 2)
                       AS predicted_revenue
            FROM ends""",
        "revenue_by_status": f"""{base}
            SELECT order_status, COUNT(*) AS orders_count,
                   CAST(SUM(total_amount) AS DOUBLE) AS revenue
            FROM shop_orders WHERE order_date >= DATE '1998-01-01' GROUP BY order_status""",
        "cohort_retention": f"{_with(SHOP, COHORTS)} SELECT * FROM retention",
        # As wide as the data: a column for every period up to the last one.
        "cohort_matrix": f"""{_with(SHOP, COHORTS)}
            SELECT cohort_month, {periods} FROM retention GROUP BY cohort_month""",
        "product_performance": f"{performance} SELECT * FROM report",
        "products_filtered": f"""{performance}
            SELECT * FROM report WHERE category_name IN ('PROMO', 'SMALL')""",
        "product_quartiles": f"""{base}, q AS (
            SELECT p.product_id, p.product_name, p.brand,
                   CAST(SUM(i.quantity) AS BIGINT) AS units_sold,
                   SUM(i.line_total) AS r,
                   COUNT(DISTINCT o.customer_id) AS unique_customers,
                   CAST(SUM(i.unit_price - p.unit_cost) AS DOUBLE) / COUNT(i.unit_price)
                       AS avg_profit_margin
            FROM shop_products p
            JOIN shop_items i ON i.product_id = p.product_id
            JOIN valid_orders o ON o.order_id = i.order_id
            GROUP BY p.product_id, p.product_name, p.brand)
            SELECT product_id, product_name, brand, units_sold, CAST(r AS DOUBLE) AS revenue,
                   unique_customers, avg_profit_margin,
                   RANK() OVER (ORDER BY r DESC) AS revenue_rank,
                   NTILE(4) OVER (ORDER BY r DESC, product_id) AS performance_quartile
            FROM q""",
        "category_summary": f"""{performance}
            SELECT category_name, CAST(SUM(total_revenue) AS DOUBLE) AS total_revenue,
                   CAST(SUM(total_units_sold) AS BIGINT) AS total_units_sold,
                   CAST(SUM(total_profit_cents) AS DOUBLE) / 100 AS total_profit
            FROM sold GROUP BY category_name""",
        "top_products": f"""{performance}
            SELECT {REPORT_COLUMNS}, pct_of_total_revenue FROM report
            ORDER BY total_revenue DESC, product_id LIMIT 15""",
        "chosen_top_products": f"""{performance}
            SELECT {REPORT_COLUMNS}, pct_of_total_revenue FROM report
            ORDER BY total_revenue DESC, product_id LIMIT 25""",
        "chosen_top_customers": f"{spending} {top_customers} LIMIT 25",
        "brand_share": f"""{performance}
            SELECT brand, COUNT(*) AS products,
                   CAST(SUM(CAST(pct_of_total_revenue AS DECIMAL(12,2))) AS DOUBLE) AS brand_pct
            FROM report WHERE brand = 'Brand#1' GROUP BY brand""",
        "above_median_profit": f"""{performance}
            SELECT COUNT(*) AS products FROM report
            WHERE profit_per_unit > (SELECT median(profit_per_unit) FROM report)""",
        "product_quadrants": f"""{_with(SHOP, PERFORMANCE, _QUADRANTS)}
            SELECT * FROM quadrants""",
        "product_bubbles": f"""{_with(SHOP, PERFORMANCE, _QUADRANTS)}
            SELECT * FROM quadrants ORDER BY total_revenue DESC, product_id LIMIT 30""",
        "product_affinity": f"""{base},
            lines AS (
                SELECT DISTINCT i.order_id, i.product_id
                FROM shop_items i JOIN valid_orders o ON o.order_id = i.order_id
            ),
            single AS (SELECT product_id, COUNT(*) AS n FROM lines GROUP BY product_id),
            both_in AS (
                SELECT x.product_id AS product_a, y.product_id AS product_b,
                       COUNT(*) AS pair_orders
                FROM lines x JOIN lines y
                  ON x.order_id = y.order_id AND x.product_id < y.product_id
                GROUP BY 1, 2 HAVING COUNT(*) >= 2
            ),
            total AS (SELECT COUNT(*) AS n FROM valid_orders)
            SELECT product_a, product_b, pair_orders,
                   CAST(pair_orders AS DOUBLE) / total.n AS support,
                   CAST(pair_orders AS DOUBLE) / a.n AS confidence_a_to_b,
                   CAST(pair_orders AS DOUBLE) / b.n AS confidence_b_to_a,
                   (CAST(pair_orders AS DOUBLE) / a.n) / (CAST(b.n AS DOUBLE) / total.n) AS lift
            FROM both_in
            JOIN single a ON a.product_id = product_a
            JOIN single b ON b.product_id = product_b, total""",
        "filter_domains": f"""{spending}
            SELECT 'first_month' AS domain,
                   CAST(CAST(date_trunc('month', MIN(order_date)) AS DATE) AS VARCHAR) AS value
            FROM valid_orders
            UNION ALL
            SELECT 'last_month',
                   CAST(CAST(date_trunc('month', MAX(order_date)) AS DATE) AS VARCHAR)
            FROM valid_orders
            UNION ALL SELECT DISTINCT 'customer_tier', customer_tier FROM paying
            UNION ALL
            SELECT DISTINCT 'category_name', p.category_name
            FROM shop_products p JOIN shop_items i ON i.product_id = p.product_id
            JOIN valid_orders o ON o.order_id = i.order_id""",
        "daily_sales": f"{_with(SHOP, _daily())} SELECT * EXCLUDE (revenue) FROM daily",
        "daily_sales_by_payment": f"""{_with(SHOP, _daily("payment_method"))}
            SELECT * EXCLUDE (revenue) FROM daily""",
        "sales_features": _sales_features(lagged=False),
        "sales_features_lagged": _sales_features(lagged=True),
        "churn_features": f"{line_features} SELECT * FROM churn",
        "churn_features_order": f"{order_features} SELECT * FROM churn",
        "churn_features_at_horizon": f"""{_with(SHOP, horizon)},
            came_back AS (
                SELECT DISTINCT customer_id FROM valid_orders
                WHERE order_date > DATE '2001-04-03' AND order_date <= DATE '2001-08-01'
            )
            SELECT churn.* EXCLUDE (is_churned),
                   CASE WHEN came_back.customer_id IS NULL THEN 1 ELSE 0 END AS is_churned
            FROM churn LEFT JOIN came_back ON came_back.customer_id = churn.customer_id""",
        "churn_model_inputs": model_inputs,
        "churn_dataset_summary": f"""{line_features}
            SELECT COUNT(*) AS customers,
                   CAST(SUM(is_churned) AS DOUBLE) / COUNT(*) AS churn_rate,
                   CAST(SUM(CAST(total_spent AS DECIMAL(28,2))) AS DOUBLE) / COUNT(*)
                       AS avg_total_spent,
                   CAST(SUM(total_orders) AS DOUBLE) / COUNT(*) AS avg_total_orders
            FROM churn""",
        "clv_by_tier": f"""{order_features}
            SELECT customer_tier, COUNT(*) AS customers,
                   CAST(SUM(CAST(total_spent AS DECIMAL(28,2))) AS DOUBLE) / COUNT(*) AS avg_clv,
                   CAST(SUM(days_since_last_order) AS DOUBLE) / COUNT(*) AS avg_recency,
                   CAST(SUM(orders_last_90_days) AS DOUBLE) / COUNT(*) AS recent_activity
            FROM churn GROUP BY customer_tier""",
        "retention_alert_count": f"""{order_features}
            SELECT COUNT(*) AS high_risk_customers FROM churn WHERE {_AT_RISK}""",
        "revenue_trend_signal": f"{_with(SHOP, SIGNAL)} SELECT * FROM signal",
        "business_insights": f"""{_with(SHOP, _churn_features("order"), SIGNAL)},
            risky AS (SELECT COUNT(*) AS n FROM churn WHERE {_AT_RISK})
            SELECT 'warning' AS type, 'Customer Retention Alert' AS title,
                   n || ' customers haven''t ordered in 90+ days and may be at risk of churning.'
                       AS message,
                   'Consider targeted re-engagement campaigns.' AS action
            FROM risky WHERE n > 0
            UNION ALL
            SELECT 'success', 'Strong Growth Detected',
                   printf('Revenue increased by %.1f%% last month - excellent momentum!',
                          growth_rate),
                   'Consider scaling successful marketing channels.'
            FROM signal WHERE signal = 'growth'
            UNION ALL
            SELECT 'warning', 'Revenue Decline Alert',
                   printf('Revenue decreased by %.1f%% last month.', ABS(growth_rate)),
                   'Investigate causes and implement recovery strategies.'
            FROM signal WHERE signal = 'decline'""",
        "dashboard_payload": f"""{base}
            SELECT '{{"revenueForecast":' || CAST(SUM(total_amount) AS VARCHAR)
                   || ',"modelAccuracy":0.982,"activeCustomers":' || COUNT(DISTINCT customer_id)
                   || ',"predictionsToday":' || COUNT(*)
                   || ',"lastUpdated":"2001-08-01T00:00:00Z","status":"live"}}' AS payload
            FROM valid_orders""",
        "order_totals": f"""{base},
            sums AS (
                SELECT o.order_id, o.customer_id, COALESCE(c.customer_tier, 'Bronze') AS tier,
                       CAST(COALESCE(SUM(i.line_total), 0) AS DECIMAL(18,4)) AS subtotal
                FROM shop_orders o
                LEFT JOIN shop_items i ON i.order_id = o.order_id
                LEFT JOIN shop_customers c ON c.customer_id = o.customer_id
                GROUP BY ALL
            ),
            priced AS (
                SELECT *, ROUND(subtotal * 0.21, 2) AS tax_amount,
                       CASE WHEN subtotal > 50 THEN 0.00 ELSE 5.95 END AS shipping_cost,
                       ROUND(subtotal * CASE tier WHEN 'BUILDING' THEN 0.05
                                             WHEN 'MACHINERY' THEN 0.10 ELSE 0.00 END, 2)
                           AS eligible_discount
                FROM sums
            ),
            granted AS (
                SELECT *, CASE WHEN order_id % 100 < CASE tier WHEN 'BUILDING' THEN 20
                                    WHEN 'MACHINERY' THEN 30 ELSE 0 END
                               THEN eligible_discount ELSE 0 END AS discount_amount
                FROM priced
            )
            SELECT order_id, customer_id, tier, CAST(subtotal AS DOUBLE) AS subtotal,
                   CAST(tax_amount AS DOUBLE) AS tax_amount,
                   CAST(shipping_cost AS DOUBLE) AS shipping_cost,
                   CAST(eligible_discount AS DOUBLE) AS eligible_discount,
                   CAST(discount_amount AS DOUBLE) AS discount_amount,
                   CAST(subtotal + tax_amount + shipping_cost - discount_amount AS DOUBLE)
                       AS total_amount
            FROM granted""",
        "product_labels": f"""{base}
            SELECT product_id,
                   upper(substr(brand, 1, 3)) || '-' || (product_id % 90000 + 10000) AS sku,
                   'High-quality ' || product_name || ' from ' || brand AS description
            FROM shop_products""",
        "customer_labels": f"""{base}
            SELECT customer_id,
                   lower(first_name) || '.' || lower(last_name) || (customer_id % 999 + 1)
                       || '@example.com' AS email,
                   substr(first_name, 1, 100) AS first_name,
                   substr(last_name, 1, 100) AS last_name
            FROM shop_customers""",
        "combined_catalogue": f"""{base}
            SELECT product_id, product_name, brand,
                   CASE WHEN category_name IN ('PROMO', 'SMALL') THEN category_name
                        ELSE 'STANDARD' END AS category_name
            FROM shop_products""",
        "quality_report": f"{base} {_RULES}",
        "kpi_texts": f"""{base}, n AS (
            SELECT (SELECT COUNT(*) FROM shop_customers) AS customers,
                   (SELECT COUNT(*) FROM shop_products WHERE is_active) AS products,
                   COUNT(*) AS orders, SUM(total_amount) AS revenue,
                   COUNT(DISTINCT customer_id) AS active
            FROM valid_orders)
            SELECT 'Total Customers' AS label, format('{{:,}}', customers) AS text FROM n
            UNION ALL SELECT 'Total Orders', format('{{:,}}', orders) FROM n
            UNION ALL SELECT 'Active Products', format('{{:,}}', products) FROM n
            UNION ALL SELECT 'Total Revenue', {_money("CAST(revenue * 100 AS HUGEINT)")} FROM n
            UNION ALL SELECT 'Avg Order Value', {_money(_cents("revenue", "orders"))} FROM n
            UNION ALL SELECT 'Active Customers', format('{{:,}}', active) FROM n""",
        "customer_spending": f"""{spending}
            SELECT customer_id, first_name, last_name, customer_tier, registration_date,
                   total_orders, CAST(total_spent AS DOUBLE) AS total_spent FROM spending""",
        "top_customer": f"{spending} {top_customers} LIMIT 1",
        "star_product": f"""{performance}
            SELECT {REPORT_COLUMNS}, pct_of_total_revenue FROM report
            ORDER BY total_revenue DESC, product_id LIMIT 1""",
        "repeat_buyers_by_id": f"""{spending}
            SELECT * FROM paying WHERE customer_id IN (
                SELECT customer_id FROM shop_orders GROUP BY customer_id HAVING COUNT(*) > 10)""",
        "products_of_brand": f"{performance} SELECT * FROM report WHERE brand = 'Brand#1'",
        "order_lines": f"""{base}
            SELECT o.order_id, o.customer_id, o.order_date, o.payment_method,
                   CAST(o.total_amount AS DOUBLE) AS total_amount, i.product_id, i.quantity,
                   CAST(i.line_total AS DOUBLE) AS line_total
            FROM valid_orders o LEFT JOIN shop_items i ON i.order_id = o.order_id""",
        "recent_monthly_revenue": recent_months,
        "at_risk_customers": f"{order_features} SELECT * FROM churn WHERE {_AT_RISK}",
        "sales_features_by_payment": _sales_features(lagged=False, series="payment_method"),
        "appended_customers": f"""{base}
            SELECT customer_tier, customer_id FROM shop_customers
            WHERE customer_tier IS NOT NULL""",
        "appended_once": f"""{base}
            SELECT customer_tier, customer_id FROM shop_customers
            WHERE customer_tier IS NOT NULL""",
        "pruned_monthly_revenue": recent_months,
        "pruned_tier_revenue": f"""{base}
            SELECT customer_tier, COUNT(*) AS orders_count,
                   CAST(SUM(total_amount) AS DOUBLE) AS revenue
            FROM valid_orders JOIN shop_customers USING (customer_id)
            WHERE EXTRACT(quarter FROM order_date) = 2
              AND customer_tier IN ('BUILDING', 'MACHINERY')
            GROUP BY customer_tier""",
        "maintained_sales_features": _sales_features(lagged=False),
        "maintained_churn_features": f"{order_features} SELECT * FROM churn",
        "profit_quartile_limits": f"""{performance},
            numbered AS (
                SELECT total_profit, row_number() OVER (ORDER BY total_profit) AS place,
                       COUNT(*) OVER () AS n
                FROM report WHERE total_profit IS NOT NULL
            ),
            parts AS (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS part)
            SELECT part, total_profit AS "limit",
                   (SELECT COUNT(*) FROM report r WHERE r.total_profit <= l.total_profit)
                       AS rows_up_to
            FROM parts JOIN numbered l ON l.place = (part * n + 3) // 4""",
        "churn_scaled_inputs": f"""
            SELECT customer_id, {scaled}, is_churned FROM ({model_inputs})""",
        "sql_over_views": f"""{order_features}
            SELECT customer_tier, COUNT(*) AS customers,
                   CAST(SUM(CAST(total_spent AS DECIMAL(28,2))) AS DOUBLE) / COUNT(*) AS avg_clv,
                   CAST(SUM(days_since_last_order) AS DOUBLE) / COUNT(*) AS avg_recency,
                   CAST(SUM(orders_last_90_days) AS DOUBLE) / COUNT(*) AS recent_activity
            FROM churn GROUP BY customer_tier""",
        "stream_daily_sales": daily_sales,
        "stream_late_days": daily_sales,
        "stream_running_totals": f"""{base}
            SELECT COUNT(*) AS total_orders, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
                   CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value,
                   COUNT(DISTINCT customer_id) AS active_customers, TRUE AS estimate_is_near
            FROM valid_orders""",
        "stream_exact_totals": f"""{base}
            SELECT COUNT(*) AS total_orders, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
                   CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value,
                   COUNT(DISTINCT customer_id) AS active_customers
            FROM valid_orders""",
        "stream_first_arrivals": valid_rows,
        "stream_insert_once": valid_rows,
        "stream_sales_features": _sales_features(lagged=False),
        "stream_sales_features_by_payment": _sales_features(
            lagged=False, series="payment_method"
        ),
        **part_oracles(
            line_features,
            order_features,
            _sales_features(lagged=False),
            _sales_features(lagged=False, series="payment_method"),
        ),
    }
