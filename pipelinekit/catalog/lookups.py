"""Queries of the lookups: orders looked up by customer, event values by range."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.operators import lookups as ops
from pipelinekit.operators.prepared import prepare_lookup
from pipelinekit.operators.running import in_lists

ON = {"c_custkey": "o_custkey"}
ORDER = ["o_orderdate", "o_orderkey"]
COLS = ["o_orderpriority", "o_orderstatus"]


def _customers(spark, sf_dir):
    """Customers under shifted keys, so that some look for a key without orders."""
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") + 20).alias("c_custkey"), "c_name")


def lookup_first(spark, sf_dir):
    return ops.lookup(_customers(spark, sf_dir), table(spark, sf_dir, "orders"), ON, COLS, "first", ORDER)


def lookup_last(spark, sf_dir):
    return ops.lookup(_customers(spark, sf_dir), table(spark, sf_dir, "orders"), ON, COLS, "last", ORDER)


def lookup_nth(spark, sf_dir):
    return ops.lookup(_customers(spark, sf_dir), table(spark, sf_dir, "orders"), ON, COLS, "nth", ORDER, n=3)


def lookup_match(spark, sf_dir):
    return ops.lookup_match(_customers(spark, sf_dir), table(spark, sf_dir, "orders"), ON)


def lookup_count(spark, sf_dir):
    return ops.lookup_count(_customers(spark, sf_dir), table(spark, sf_dir, "orders"), ON)


def _rows(spark, sf_dir, reverse):
    """Lists of four orders, so that most customers fill several chunks."""
    found = ops.lookup_rows(_customers(spark, sf_dir), table(spark, sf_dir, "orders"), ON, ["o_orderkey"], ORDER, reverse)
    lists = in_lists(found, ["c_custkey"], F.col("o_orderkey").cast("string"), 4, "rows")
    return lists.withColumn("rows", F.array_join("rows", ","))


def lookup_rows(spark, sf_dir):
    return _rows(spark, sf_dir, False)


def lookup_rows_reversed(spark, sf_dir):
    return _rows(spark, sf_dir, True)


def lookup_range(spark, sf_dir):
    """Event values in bands of 15, one per nation, with gaps of 5 between them."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    bands = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") * 20).cast("double").alias("lo"), (F.col("n_nationkey") * 20 + 15).cast("double").alias("hi"), "n_name"
    )
    return ops.range_lookup(events, bands, "value", "lo", "hi", ["n_name"])


def lookup_range_open(spark, sf_dir):
    """Event values in overlapping ranges from 1 to 1e9 wide, some without a lower or an upper end."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    n, none = F.col("n_nationkey"), float("inf")
    lo = F.when(n % 5 == 1, F.lit(-none)).otherwise((n * 4).cast("double"))
    hi = F.when(n % 5 == 1, (n * 2).cast("double")).when(n % 5 == 2, F.lit(none)).otherwise(n * 4 + F.pow(F.lit(10.0), n % 10))
    bands = table(spark, sf_dir, "nation").select(lo.alias("lo"), hi.alias("hi"), "n_name")
    return ops.range_lookup(events, bands, "value", "lo", "hi", ["n_name"])


def prepared_lookups(spark, sf_dir):
    """Orders prepared by customer once: looked up by customers, and by events through another column."""
    orders = prepare_lookup(table(spark, sf_dir, "orders"), ["o_custkey"], COLS, ORDER)
    customers = orders.every(_customers(spark, sf_dir), ON).withColumn("asked_by", F.lit("customer"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.lit("event").alias("c_name"), F.col("event_id"))
    named = {"c_custkey": "o_custkey"}
    counted = orders.count(orders.match(orders.last(orders.first(events, named, "first_"), named, "last_"), named), named)
    per_user = counted.groupBy(*[c for c in counted.columns if c not in ("event_id",)]).agg(F.count(F.lit(1)).alias("rows"))
    return customers.withColumn("rows", F.lit(1).cast("long")).unionByName(per_user.withColumn("asked_by", F.lit("event")))


QUERIES = {
    "prepared_lookups": prepared_lookups,
    "lookup_first": lookup_first,
    "lookup_last": lookup_last,
    "lookup_nth": lookup_nth,
    "lookup_match": lookup_match,
    "lookup_count": lookup_count,
    "lookup_rows": lookup_rows,
    "lookup_rows_reversed": lookup_rows_reversed,
    "lookup_range": lookup_range,
    "lookup_range_open": lookup_range_open,
}

_CUSTOMERS = "(SELECT c_custkey + 20 AS c_custkey, c_name FROM customer)"


def _ranked(direction: str, n: int) -> str:
    return f"""
SELECT c.c_custkey, c_name, f.o_orderpriority, f.o_orderstatus FROM {_CUSTOMERS} c LEFT JOIN (
  SELECT * FROM orders QUALIFY row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate {direction}, o_orderkey {direction}) = {n}) f ON o_custkey = c.c_custkey"""


def _listed(direction: str) -> str:
    return f"""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (
             PARTITION BY o_custkey ORDER BY o_orderdate {direction}, o_orderkey {direction}) AS pos FROM orders),
l AS (SELECT o_custkey, CAST((pos - 1) // 4 AS INTEGER) AS chunk,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY pos) AS rows FROM r GROUP BY 1, 2)
SELECT c_custkey, coalesce(chunk, 0) AS chunk, rows FROM {_CUSTOMERS} c LEFT JOIN l ON o_custkey = c_custkey"""


_ENDS = """
ends AS (
  SELECT o_custkey, count(*) AS n, arg_min(struct_pack(p := o_orderpriority, s := o_orderstatus), (o_orderdate, o_orderkey)) AS f,
    arg_max(struct_pack(p := o_orderpriority, s := o_orderstatus), (o_orderdate, o_orderkey)) AS l FROM orders GROUP BY 1)"""
_FOUND = """f.p AS first_o_orderpriority, f.s AS first_o_orderstatus, l.p AS last_o_orderpriority, l.s AS last_o_orderstatus,
  n IS NOT NULL AS matched, coalesce(n, 0) AS matches"""
_COUNTED = "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"

ORACLE = {
    "prepared_lookups": f"""
WITH {_ENDS}
SELECT c_custkey, c_name, {_FOUND}, 'customer' AS asked_by, 1 AS rows FROM {_CUSTOMERS} LEFT JOIN ends ON o_custkey = c_custkey
UNION ALL
SELECT u.user_id, 'event', {_FOUND}, 'event', rows FROM (SELECT user_id, count(*) AS rows FROM events GROUP BY 1) u
  LEFT JOIN ends ON o_custkey = u.user_id""",
    "lookup_first": _ranked("ASC", 1),
    "lookup_last": _ranked("DESC", 1),
    "lookup_nth": _ranked("ASC", 3),
    "lookup_match": f"""
SELECT c_custkey, c_name, n IS NOT NULL AS matched FROM {_CUSTOMERS} c LEFT JOIN {_COUNTED} ON o_custkey = c_custkey""",
    "lookup_count": f"""
SELECT c_custkey, c_name, coalesce(n, 0) AS matches FROM {_CUSTOMERS} c LEFT JOIN {_COUNTED} ON o_custkey = c_custkey""",
    "lookup_rows": _listed("ASC"),
    "lookup_rows_reversed": _listed("DESC"),
    "lookup_range": """
SELECT event_id, value, n_name FROM events LEFT JOIN nation
ON value >= n_nationkey * 20 AND value < n_nationkey * 20 + 15""",
    "lookup_range_open": """
SELECT event_id, value, n_name FROM events LEFT JOIN nation
ON (n_nationkey % 5 = 1 OR value >= n_nationkey * 4)
AND CASE n_nationkey % 5 WHEN 1 THEN value < n_nationkey * 2 WHEN 2 THEN true
  ELSE value < n_nationkey * 4 + pow(10.0, n_nationkey % 10) END""",
}
