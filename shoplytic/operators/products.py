"""Product performance, category and brand summaries, profitability quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytic.functions.numeric import mean_of, quotient_to_cents, share_pct
from shoplytic.operators.filters import checked_top_n
from shoplytic.operators.ranking import exact_median, global_ranks, ntile
from shoplytic.schema import Tables, valid_orders
from shoplytic.session import pinned

REPORT_COLUMNS = (
    "product_id",
    "product_name",
    "brand",
    "category_name",
    "times_ordered",
    "total_units_sold",
    "total_revenue",
    "avg_selling_price",
    "profit_per_unit",
    "total_profit",
)


def sold_items(t: Tables, *order_columns: str) -> DataFrame:
    """Lines of valid orders; order columns only when asked for.

    Both sides move by ``order_id``. A single huge order is split by AQE, as it
    sits on the streamed side of the join.
    """
    orders = valid_orders(t).select("order_id", *order_columns)
    how = "inner" if order_columns else "left_semi"
    return t.order_items.join(orders, "order_id", how)


def order_lines(t: Tables) -> DataFrame:
    """Valid orders at line grain: one row per line, and one for an order without any."""
    orders = valid_orders(t).select(
        "order_id", "customer_id", "order_date", "payment_method", "total_amount"
    )
    lines = t.order_items.select("order_id", "product_id", "quantity", "line_total")
    return orders.join(lines, "order_id", "left")


def product_sales(t: Tables) -> DataFrame:
    """Per sold product: lines, units, exact revenue, price and profit figures.

    Lines are summed per product before the catalogue is joined, so a best
    seller never sits in one join task. ``revenue`` is the unrounded amount.
    """
    sums = sold_items(t).groupBy("product_id").agg(
        F.count("order_item_id").alias("times_ordered"),
        F.count("unit_price").alias("priced_lines"),
        F.sum(F.col("quantity").cast("long")).alias("total_units_sold"),
        F.sum("line_total").alias("revenue"),
        F.sum("unit_price").alias("price_sum"),
    )
    catalogue = t.products.join(t.categories, "category_id").select(
        "product_id", "product_name", "brand", "category_name", "unit_cost"
    )
    lines = F.col("priced_lines")
    margin_sum = F.col("price_sum") - F.col("unit_cost") * lines
    return sums.join(catalogue, "product_id").select(
        "product_id",
        "product_name",
        "brand",
        "category_name",
        "times_ordered",
        "total_units_sold",
        F.round("revenue", 2).alias("total_revenue"),
        quotient_to_cents(F.col("price_sum"), lines).alias("avg_selling_price"),
        quotient_to_cents(margin_sum, lines).alias("profit_per_unit"),
        quotient_to_cents(margin_sum * F.col("total_units_sold"), lines).alias("total_profit"),
        "revenue",
    )


def product_performance(t: Tables) -> DataFrame:
    """``product_sales`` with revenue rank and revenue share."""
    ranked = global_ranks(
        product_sales(t), value="revenue", tie_break="product_id", rank="revenue_rank"
    )
    return ranked.select(
        *REPORT_COLUMNS,
        "revenue_rank",
        share_pct(F.col("revenue"), F.col("value_total")).alias("pct_of_total_revenue"),
    )


def with_share(sales: DataFrame) -> DataFrame:
    """Revenue share without the rank: no sort.

    The products are pinned, so their total does not sum all lines a second time.
    """
    sales = pinned(sales)
    whole = sales.agg(F.sum("revenue")).scalar()
    return sales.withColumn("pct_of_total_revenue", share_pct(F.col("revenue"), whole))


def by_revenue():
    return F.col("total_revenue").desc(), F.col("product_id").asc()


def top_products(t: Tables, n: int = 15) -> DataFrame:
    """The ``n`` products with the highest revenue."""
    top = with_share(product_sales(t)).orderBy(*by_revenue()).limit(n)
    return top.select(*REPORT_COLUMNS, "pct_of_total_revenue")


def chosen_top_products(t: Tables, n: int) -> DataFrame:
    """As ``top_products``, for a number that a reader picked from the allowed ones."""
    return top_products(t, checked_top_n(n))


def product_quartiles(t: Tables) -> DataFrame:
    """Units, revenue, distinct buyers, mean margin, with rank and revenue quartile."""
    sums = sold_items(t, "customer_id").groupBy("product_id").agg(
        F.sum(F.col("quantity").cast("long")).alias("units_sold"),
        F.sum("line_total").alias("revenue"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("unit_price").alias("price_sum"),
        F.count("unit_price").alias("priced_lines"),
    )
    margin_sum = F.col("price_sum") - F.col("unit_cost") * F.col("priced_lines")
    catalogue = t.products.select("product_id", "product_name", "brand", "unit_cost")
    performance = sums.join(catalogue, "product_id").select(
        "product_id",
        "product_name",
        "brand",
        "units_sold",
        "revenue",
        "unique_customers",
        mean_of(margin_sum, F.col("priced_lines")).alias("avg_profit_margin"),
    )
    ranked = global_ranks(
        performance, value="revenue", tie_break="product_id", rank="revenue_rank"
    )
    return ranked.select(
        *performance.columns,
        "revenue_rank",
        ntile(F.col("row_number"), F.col("rows_total"), 4).alias("performance_quartile"),
    )


def category_summary(t: Tables) -> DataFrame:
    """Revenue, units and profit per category, summed from the rounded product figures."""
    return (
        product_sales(t)
        .groupBy("category_name")
        .agg(
            F.sum("total_revenue").alias("total_revenue"),
            F.sum("total_units_sold").alias("total_units_sold"),
            F.sum("total_profit").alias("total_profit"),
        )
    )


def brand_share(t: Tables, brand: str) -> DataFrame:
    """One row with a brand's summed revenue share; none if it sold nothing."""
    return (
        with_share(product_sales(t))
        .filter(F.col("brand") == brand)
        .agg(
            F.count("*").alias("products"),
            F.sum(F.col("pct_of_total_revenue").cast("decimal(12,2)")).alias("brand_pct"),
        )
        .filter(F.col("products") > 0)
        .select(F.lit(brand).alias("brand"), "products", "brand_pct")
    )


def above_median_profit(t: Tables) -> DataFrame:
    """One row: how many products earn strictly more per unit than the median."""
    profits = pinned(product_sales(t).select("profit_per_unit"))
    median = exact_median(profits, "profit_per_unit").scalar()
    return profits.agg(
        F.count_if(F.col("profit_per_unit").cast("double") > median).alias("products")
    )


def product_quadrants(t: Tables, n: int | None = None) -> DataFrame:
    """Products by volume and profit against the medians of all products.

    A product on a median counts as high. ``n`` keeps the top products by
    revenue only; the medians stay those of all products.
    """
    sales = pinned(product_sales(t))
    units = exact_median(sales, "total_units_sold").scalar()
    profit = exact_median(sales, "profit_per_unit").scalar()
    volume = F.when(F.col("total_units_sold") >= F.col("median_units"), "High Volume")
    margin = F.when(F.col("profit_per_unit") >= F.col("median_profit"), "High Profit")
    shown = sales.orderBy(*by_revenue()).limit(n) if n else sales
    return shown.select(
        *REPORT_COLUMNS, units.alias("median_units"), profit.alias("median_profit")
    ).select(
        "*",
        F.concat_ws(
            " / ", volume.otherwise("Low Volume"), margin.otherwise("Low Profit")
        ).alias("quadrant"),
    )


def filter_domains(t: Tables) -> DataFrame:
    """What a reader can choose from: month bounds, tiers and categories that occur."""
    from shoplytic.functions.dates import month_start
    from shoplytic.operators.customers import paying_customers

    def choices(df: DataFrame, domain: str, column) -> DataFrame:
        return df.select(F.lit(domain).alias("domain"), column.cast("string").alias("value"))

    months = valid_orders(t).agg(
        month_start(F.min("order_date")).alias("first"),
        month_start(F.max("order_date")).alias("last"),
    )
    tiers = paying_customers(t).select("customer_tier").distinct()
    sold = sold_items(t).select("product_id").distinct()
    categories = (
        t.products.join(sold, "product_id", "left_semi")
        .join(t.categories, "category_id")
        .select("category_name")
        .distinct()
    )
    return (
        choices(months, "first_month", F.col("first"))
        .unionByName(choices(months, "last_month", F.col("last")))
        .unionByName(choices(tiers, "customer_tier", F.col("customer_tier")))
        .unionByName(choices(categories, "category_name", F.col("category_name")))
    )
