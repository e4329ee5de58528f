"""Customer order pipelines: totals per customer, account summaries, top customers.

Columns follow the order dataset (order_id, customer_id, amount) and the customer
dataset (customer_id, first_name, last_name, account_open_date).

Joining first and grouping by the same key afterwards would send every order of a
busy customer to one task. The whole pipelines below sum the orders before the join
instead, so a customer holding a third of all orders costs one row per map task. The
join then meets one row per key on each side and reuses their hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Each order with its customer's details; orders without a customer are dropped."""
    o, c = orders.alias("o"), customers.alias("c")
    return o.join(c, F.col("o.customer_id") == F.col("c.customer_id"), "inner").select(
        "c.account_open_date", "o.order_id", "o.customer_id", "o.amount", "c.first_name", "c.last_name"
    )


def customers_with_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Each customer's name with each of the customer's order amounts."""
    c, o = customers.alias("c"), orders.alias("o")
    return c.join(o, F.col("c.customer_id") == F.col("o.customer_id"), "inner").select(
        "c.first_name", "c.last_name", "o.amount", "c.customer_id"
    )


def account_age(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Replace the account's opening date by its age in days at ``as_of`` (today)."""
    opened = F.col("account_open_date").try_cast("date")
    days = F.datediff(F.current_date() if as_of is None else as_of, opened)
    return df.select(days.alias("account_length_days"), "order_id", "customer_id", "amount")


def order_totals(orders: DataFrame, *details: Column) -> DataFrame:
    """Number of orders and summed amount per customer, and further ``details`` of its orders."""
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("orders"), F.sum("amount").alias("amounts"), *details
    )


def _joined_totals(totals: DataFrame, customers: DataFrame, *details: Column) -> DataFrame:
    """Totals over the join of orders and customers, from the totals per customer.

    A customer listed several times matches each of its orders that many times; the
    ``details`` aggregate its copies.
    """
    per_customer = customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("copies"), *details)
    joined = totals.join(per_customer, "customer_id")
    return joined.withColumns(
        {"orders": F.col("orders") * F.col("copies"), "amounts": F.col("amounts") * F.col("copies")}
    ).drop("copies")


def customer_orders(orders: DataFrame, customers: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Orders, amounts and account age per customer; of several opening dates the first counts."""
    opened = F.min(F.col("account_open_date").try_cast("date")).alias("opened")
    days = F.datediff(F.current_date() if as_of is None else as_of, F.col("opened"))
    return _joined_totals(order_totals(orders), customers, opened).select(
        "customer_id", "orders", "amounts", days.alias("account_length_days")
    )


def customer_orders_from_first(orders: DataFrame, customers: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The same for accounts that open with the customer's first order (``order_date``), found with the totals."""
    totals = order_totals(orders, F.min(F.col("order_date").cast("date")).alias("opened"))
    days = F.datediff(F.current_date() if as_of is None else as_of, F.col("opened"))
    return _joined_totals(totals, customers).select("customer_id", "orders", "amounts", days.alias("account_length_days"))


def full_name_totals(totals: DataFrame) -> DataFrame:
    """Full name and amount rounded up; a missing name part makes the name null."""
    name = F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))
    return totals.select(name.alias("full_name"), F.ceil("amounts").cast("long").alias("amount"), "customer_id")


def customer_totals(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Total amount per customer, largest first.

    The customer id breaks ties, so equal amounts cannot pile up in one sort range.
    """
    totals = _joined_totals(order_totals(orders), customers, F.min(F.struct("first_name", "last_name")).alias("name"))
    named = totals.select("customer_id", "amounts", "name.first_name", "name.last_name")
    return full_name_totals(named).orderBy(F.col("amount").desc(), "customer_id")


def top_customers(summary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` customers with the largest amounts: sort and limit run as one top-k."""
    return summary.orderBy(F.col("amounts").desc(), "customer_id").limit(n)
