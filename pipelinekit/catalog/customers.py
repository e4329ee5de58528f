"""Queries of the customer, market and reformat pipelines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.functions.literals import typed_lit
from pipelinekit.operators.checks import RunMetrics
from pipelinekit.plans import customers as plan
from pipelinekit.plans.config import ReformatConfig, load_config
from pipelinekit.plans.markets import market_report
from pipelinekit.plans.reformat import reformat_then
from pipelinekit.sources import DatasetSpec, read, write
from pipelinekit.storage import scratch_path

AS_OF = "2002-01-01"
ORDER_COLUMNS = ["o_orderkey AS order_id", "o_custkey AS customer_id", "CAST(o_totalprice AS decimal(18,2)) AS amount"]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*ORDER_COLUMNS)


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.concat(F.lit("19"), F.lpad((F.col("c_nationkey") + 70).cast("string"), 2, "0"), F.lit("-02-28")).alias(
            "account_open_date"
        ),
    )


def customer_totals(spark, sf_dir):
    return plan.customer_totals(customer_rows(spark, sf_dir), order_rows(spark, sf_dir))


def named_order_amounts(spark, sf_dir):
    joined = plan.customers_with_orders(customer_rows(spark, sf_dir), order_rows(spark, sf_dir))
    return joined.withColumn("amount", F.col("amount").cast("double"))


def order_account_age(spark, sf_dir):
    joined = plan.orders_with_customers(order_rows(spark, sf_dir), customer_rows(spark, sf_dir))
    return plan.account_age(joined, F.lit(AS_OF).cast("date")).withColumn("amount", F.col("amount").cast("double"))


def customer_orders_summary(spark, sf_dir):
    """The account opens with the customer's first order."""
    orders = table(spark, sf_dir, "orders").selectExpr(*ORDER_COLUMNS, "o_orderdate AS order_date")
    summary = plan.customer_orders_from_first(orders, customer_rows(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return summary.withColumn("amounts", F.col("amounts").cast("double"))


def account_age_today(spark, sf_dir):
    """Ages as of today, less the days since a fixed date: the same on every day."""
    joined = plan.orders_with_customers(order_rows(spark, sf_dir), customer_rows(spark, sf_dir))
    today = F.datediff(F.current_date(), F.lit(AS_OF).cast("date"))
    aged = plan.account_age(joined).withColumn("account_length_days", F.col("account_length_days") - today)
    return aged.select("order_id", F.col("account_length_days").alias("days_at_fixed_date"))


def run_metrics(spark, sf_dir):
    """Rows and nulls at every node of the customer pipeline, gathered in the one run that writes its report."""
    run = RunMetrics()
    dates = F.when(F.col("customer_id") % 5 != 0, F.col("account_open_date"))
    customers = run.node("customers", customer_rows(spark, sf_dir).withColumn("account_open_date", dates))
    orders = run.node("orders", order_rows(spark, sf_dir))
    joined = run.node("by_customer", plan.orders_with_customers(orders, customers), ["account_open_date"])
    aged = run.node("account_age", plan.account_age(joined, F.lit(AS_OF).cast("date")), ["account_length_days", "amount"])
    report = run.node("report", plan.order_totals(aged, F.max("account_length_days").alias("days")))
    write(report, DatasetSpec("parquet", scratch_path(spark, "report"), {}, None, "overwrite"))
    return run.table(spark)


def top_customers(spark, sf_dir):
    return plan.top_customers(customer_orders_summary(spark, sf_dir))


def report_top_customers(spark, sf_dir):
    """The same from a stored summary, read back with the first three of its columns."""
    options = {"separator": ",", "header": True}
    stored = DatasetSpec("csv", scratch_path(spark, "summary"), options, None, "overwrite")
    write(customer_orders_summary(spark, sf_dir), stored)
    return plan.top_customers(read(spark, replace(stored, schema="customer_id long, orders long, amounts double")))


WEIGHTS = {"1-URGENT": [5, 1], "2-HIGH": [3, 1], "3-MEDIUM": [2, 0]}


def typed_literals(spark, sf_dir):
    """Orders weighted by a literal map of arrays."""
    weight = F.try_element_at(typed_lit(WEIGHTS), "o_orderpriority")
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.coalesce(weight[0], F.lit(0)).alias("weight"), (F.size(weight) == 2).alias("known")).na.fill(False)


def segment_report(spark, sf_dir):
    """Nations as places, suppliers as markets, order priorities as brackets.

    Zip codes are nation numbers, but some are summaries or missing on either side.
    """
    def zip_of(nation, missing):
        return F.when(nation % 5 == missing, None).when(nation == 7, "00000").when(nation == 9, "99999").otherwise(nation.cast("string"))

    markets = table(spark, sf_dir, "supplier").select(zip_of(F.col("s_nationkey"), 3).alias("zip"))
    # Orders are counted per customer before the join, so a busy customer is one row per bracket.
    stub = F.substring("o_orderpriority", 1, 1).alias("agi_stub")
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey", stub).agg(F.count(F.lit(1)).alias("n"))
    nation_of = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = counted.join(nation_of, F.col("o_custkey") == F.col("c_custkey"))
    returns = orders.groupBy(zip_of(F.col("c_nationkey"), 1).alias("zipcode"), "agi_stub").agg(
        F.sum("n").cast("string").alias("N1")
    )
    return market_report(markets, returns, top_bracket=5, threshold=0.2)


def reformat_config(spark, sf_dir):
    instance = {"c_string": "fresh", "c_int": 7, "c_boolean": False}
    config = load_config(ReformatConfig, instance, {"c_int": 8})
    rows = customer_rows(spark, sf_dir).select(
        "customer_id",
        "first_name",
        "last_name",
        "account_open_date",
        *[F.lit(None).cast("string").alias(c) for c in ("phone", "email", "country_code", "account_flags")],
    )
    return reformat_then(rows, config).select("col1", "customer_id", "first_name", "last_name", "account_open_date")


def script_node(spark, sf_dir):
    rows = customer_rows(spark, sf_dir)
    return rows.transform(lambda df: df.withColumn("first_name", F.upper("first_name")))


def const_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.lit(True)).select("o_orderkey", "o_custkey", "o_orderpriority")


QUERIES = {
    "customer_totals": customer_totals,
    "named_order_amounts": named_order_amounts,
    "order_account_age": order_account_age,
    "account_age_today": account_age_today,
    "customer_orders_summary": customer_orders_summary,
    "run_metrics": run_metrics,
    "top_customers": top_customers,
    "report_top_customers": report_top_customers,
    "typed_literals": typed_literals,
    "segment_report": segment_report,
    "reformat_config": reformat_config,
    "script_node": script_node,
    "const_filter": const_filter,
}

_OPENED = "'19' || CAST(c_nationkey + 70 AS VARCHAR) || '-02-28'"
_SUMMARY = f"""
SELECT o.o_custkey AS customer_id, count(o.o_orderkey) AS orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amounts,
       CAST(date_diff('day', CAST(min(o.o_orderdate) AS DATE), DATE '{AS_OF}') AS INTEGER) AS account_length_days
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey"""

ORACLE = {
    "customer_totals": """
SELECT c_name || ' ' || c_mktsegment AS full_name,
       CAST(ceil(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS amount, c_custkey AS customer_id
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_mktsegment""",
    "named_order_amounts": """
SELECT c_name AS first_name, c_mktsegment AS last_name,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, c_custkey AS customer_id
FROM customer JOIN orders ON c_custkey = o_custkey""",
    "order_account_age": f"""
SELECT CAST(date_diff('day', CAST({_OPENED} AS DATE), DATE '{AS_OF}') AS INTEGER) AS account_length_days,
       o_orderkey AS order_id, o_custkey AS customer_id,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "account_age_today": f"""
SELECT o_orderkey AS order_id, CAST(date_diff('day', CAST({_OPENED} AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_at_fixed_date
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "customer_orders_summary": _SUMMARY,
    "run_metrics": f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN {_OPENED} END AS opened FROM customer),
j AS (SELECT o_custkey, opened FROM orders JOIN c ON o_custkey = c_custkey),
r AS (SELECT o_custkey, max(opened) AS opened FROM j GROUP BY 1)
SELECT 0 AS node_index, 'customers' AS node, (SELECT count(*) FROM c) AS rows, col AS "column",
  CASE WHEN col = 'account_open_date' THEN (SELECT count(*) FROM c WHERE opened IS NULL) ELSE 0 END AS nulls
  FROM (SELECT unnest(['customer_id', 'first_name', 'last_name', 'account_open_date']) AS col)
UNION ALL SELECT 1, 'orders', (SELECT count(*) FROM orders), unnest(['order_id', 'customer_id', 'amount']), 0
UNION ALL SELECT 2, 'by_customer', count(*), 'account_open_date', count(*) - count(opened) FROM j
UNION ALL SELECT 3, 'account_age', count(*), 'account_length_days', count(*) - count(opened) FROM j
UNION ALL SELECT 3, 'account_age', count(*), 'amount', 0 FROM j
UNION ALL SELECT 4, 'report', (SELECT count(*) FROM r), col, CASE WHEN col = 'days' THEN (SELECT count(*) - count(opened) FROM r) ELSE 0 END
  FROM (SELECT unnest(['customer_id', 'orders', 'amounts', 'days']) AS col)""",
    "top_customers": f"SELECT * FROM ({_SUMMARY}) ORDER BY amounts DESC, customer_id LIMIT 10",
    "report_top_customers": f"""
SELECT customer_id, orders, amounts FROM ({_SUMMARY}) ORDER BY amounts DESC, customer_id LIMIT 10""",
    "typed_literals": """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS weight,
       o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS known FROM orders""",
    "segment_report": """
WITH fm AS (SELECT s_nationkey AS zip, count(*) AS n FROM supplier
            WHERE s_nationkey % 5 <> 3 AND s_nationkey NOT IN (7, 9) GROUP BY 1),
r AS (SELECT c_nationkey AS zipcode,
        sum(CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 1 ELSE 0 END) AS high, count(*) AS total
      FROM orders JOIN customer ON o_custkey = c_custkey
      WHERE c_nationkey % 5 <> 1 AND c_nationkey NOT IN (7, 9) GROUP BY 1),
f AS (SELECT coalesce(fm.n, 0) > 0 AS fm, CAST(high AS DOUBLE) / total > 0.2 AS hi
      FROM fm RIGHT JOIN r ON fm.zip = r.zipcode),
t AS (SELECT CAST(sum(CASE WHEN fm AND hi THEN 1 ELSE 0 END) AS BIGINT) AS a,
             CAST(sum(CASE WHEN fm AND NOT hi THEN 1 ELSE 0 END) AS BIGINT) AS b,
             CAST(sum(CASE WHEN NOT fm AND hi THEN 1 ELSE 0 END) AS BIGINT) AS c,
             CAST(sum(CASE WHEN NOT fm AND NOT hi THEN 1 ELSE 0 END) AS BIGINT) AS d,
             count(*) AS n FROM f)
SELECT CAST(100 * a AS DOUBLE) / nullif(a + b, 0) AS has_fm_high_income_percent,
       CAST(100 * c AS DOUBLE) / nullif(c + d, 0) AS no_fm_high_income_percent,
       a AS has_fm_high_income, b AS has_fm_low_income, c AS no_fm_high_income, d AS no_fm_low_income,
       n AS num_zipcodes FROM t""",
    "reformat_config": f"""
SELECT c_name || c_mktsegment || 'fresh' || '8' || 'false' AS col1, c_custkey AS customer_id,
       c_name AS first_name, c_mktsegment AS last_name, {_OPENED} AS account_open_date FROM customer""",
    "script_node": f"""
SELECT c_custkey AS customer_id, upper(c_name) AS first_name, c_mktsegment AS last_name,
       {_OPENED} AS account_open_date FROM customer""",
    "const_filter": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE true",
}
