"""Table schemas, fixed domains, and the one predicate every revenue query shares."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Domains the shop's data uses.
ORDER_STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled")
VALID_STATUSES = ("confirmed", "shipped", "delivered")
CUSTOMER_TIERS = ("Bronze", "Silver", "Gold", "Platinum")


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CUSTOMERS = _struct(
    customer_id=T.LongType(),
    email=T.StringType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    phone=T.StringType(),
    date_of_birth=T.DateType(),
    gender=T.StringType(),
    registration_date=T.DateType(),
    customer_tier=T.StringType(),
    is_active=T.BooleanType(),
)

PRODUCTS = _struct(
    product_id=T.LongType(),
    product_name=T.StringType(),
    sku=T.StringType(),
    category_id=T.LongType(),
    brand=T.StringType(),
    description=T.StringType(),
    unit_cost=MONEY,
    selling_price=MONEY,
    weight_kg=T.DecimalType(10, 3),
    dimensions_cm=T.StringType(),
    is_active=T.BooleanType(),
)

CATEGORIES = _struct(category_id=T.LongType(), category_name=T.StringType())

CUSTOMER_ADDRESSES = _struct(
    customer_id=T.LongType(),
    address_type=T.StringType(),
    street_address=T.StringType(),
    city=T.StringType(),
    state_province=T.StringType(),
    postal_code=T.StringType(),
    country=T.StringType(),
    is_primary=T.BooleanType(),
)

ORDERS = _struct(
    order_id=T.LongType(),
    customer_id=T.LongType(),
    order_date=T.DateType(),
    order_status=T.StringType(),
    payment_method=T.StringType(),
    shipping_method=T.StringType(),
    subtotal=MONEY,
    tax_amount=MONEY,
    shipping_cost=MONEY,
    discount_amount=MONEY,
    total_amount=MONEY,
    notes=T.StringType(),
)

ORDER_ITEMS = _struct(
    order_item_id=T.LongType(),
    order_id=T.LongType(),
    product_id=T.LongType(),
    quantity=T.IntegerType(),
    unit_price=MONEY,
    line_total=MONEY,
    discount_applied=MONEY,
)

SCHEMAS: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "categories": CATEGORIES,
    "customer_addresses": CUSTOMER_ADDRESSES,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}


@dataclass(frozen=True)
class Tables:
    """The shop's six tables, plus the domains of its two coded columns.

    ``valid_statuses`` holds the raw codes that mark a revenue-bearing order, so
    the filter on them reaches the Parquet scan whatever the source calls them.
    """

    customers: DataFrame | None = None
    products: DataFrame | None = None
    categories: DataFrame | None = None
    customer_addresses: DataFrame | None = None
    orders: DataFrame | None = None
    order_items: DataFrame | None = None
    valid_statuses: tuple[str, ...] = VALID_STATUSES
    statuses: tuple[str, ...] = ORDER_STATUSES
    tiers: tuple[str, ...] = CUSTOMER_TIERS

    def with_orders(self, orders: DataFrame) -> Tables:
        return replace(self, orders=orders)


def valid_orders(t: Tables) -> DataFrame:
    """Orders that count as revenue."""
    return t.orders.filter(F.col("order_status").isin(*t.valid_statuses))
