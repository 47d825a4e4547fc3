"""E-commerce analytics on Spark: DataFrame in, DataFrame out.

Every operator takes the shop's tables (:class:`shoplytic.schema.Tables`) or a
frame another operator made, and returns a ``DataFrame`` for Spark to plan.
Operators that depend on "today" take an explicit ``as_of`` date.
"""

from shoplytic.schema import Tables, valid_orders

__all__ = ["Tables", "valid_orders"]
