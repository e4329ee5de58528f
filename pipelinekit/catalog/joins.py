"""Queries of the key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.functions.text import same_on
from pipelinekit.operators import keys
from pipelinekit.operators.state import override


def semi_filter(spark, sf_dir):
    """Orders of the customers listed in comma texts, one text per supplier."""
    texts = table(spark, sf_dir, "supplier").select(
        F.concat_ws(",", F.col("s_suppkey"), F.col("s_suppkey") + 3, (F.col("s_acctbal") / 10).cast("int")).alias("text")
    )
    listed = keys.listed_keys(texts, "text", "cust/")
    orders = table(spark, sf_dir, "orders").withColumn("key", F.concat(F.lit("cust/"), F.col("o_custkey")))
    return keys.keep_keys(orders, "key", listed).select("o_orderkey", "key")


def text_filter(spark, sf_dir):
    """Orders of the priorities named in a comma text."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("p/"), F.substring("o_orderpriority", 3, 20)).alias("priority")
    )
    return keys.keep_keys(orders, "priority", "URGENT,LOW", prefix="p/")


def anti_filter(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    urgent = urgent.select(F.col("o_custkey").alias("c_custkey"))
    return keys.drop_keys(table(spark, sf_dir, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


def moved_rows(spark, sf_dir):
    """Lines shipped under another status than their order was opened with."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"), "l_linenumber"
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return keys.moved_rows(lines, orders, "id", "status")


def pairs(spark, sf_dir):
    """Each supplier with each of a fixed list of targets."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return keys.pairs_with(supplier, "target", ["dev", "test", "prod"])


def id_or_name(spark, sf_dir):
    """Orders looking for a customer by id or, failing that, by segment name."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") * 2).cast("string").alias("asked_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1)).alias("asked_name"),
    )
    parts = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c/"), F.col("c_custkey")).alias("id"),
        F.when(F.col("c_nationkey") < 4, F.col("c_nationkey").cast("string")).alias("name"),
        "c_custkey",
    )
    found = keys.match_id_or_name(orders, parts, "asked_id", "asked_name", "id", "name", ["c_custkey"], "c/")
    return found.select("o_orderkey", "match_id", "match_name")


def first_match(spark, sf_dir):
    """The first order of each customer."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders")
    return keys.first_match(customer, orders, {"c_custkey": "o_custkey"}, ["o_orderpriority"], ["o_orderdate", "o_orderkey"])


def key_union(spark, sf_dir):
    """Nations that have customers or suppliers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("SUPPLIER").alias("kind"))
    return keys.all_keys(c, s, ["nation", "kind"])


def bag_union(spark, sf_dir):
    """Balances of two kinds of partners, each filtered first."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'")
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    c = c.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(s.select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")))


def override_column(spark, sf_dir):
    """Customers' nations, overridden by those of their priciest suppliers of the same key."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    given = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"),
        F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("s"), "s_nationkey")).otherwise("").alias("given"),
        "s_name",
    )
    return override(customer, given, "c_custkey", "c_nationkey", "given", ["s_name"])


def managed_with_component(spark, sf_dir):
    """Orders that are open, of a customer in Europe, and with a returned line."""
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 3").select("n_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    found = keys.with_component(orders, F.col("o_orderstatus") == "O", "c_nationkey", nation, "o_orderkey", returned)
    return found.select("o_orderkey", "o_custkey", "c_nationkey")


def same_rows(spark, sf_dir):
    """Whether a line agrees with its order's first line on five columns."""
    lines = table(spark, sf_dir, "lineitem")
    cols = ["l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_quantity"]
    first = keys.first_match(
        lines.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(c).alias(f"own_{c}") for c in cols]),
        lines, {"l_orderkey": "l_orderkey"}, cols, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
    same = same_on({c: F.col(f"own_{c}") for c in cols}, {c: F.col(c) for c in cols})
    return first.select("l_orderkey", "l_linenumber", "l_partkey", same.alias("same"))


QUERIES = {
    "semi_filter": semi_filter,
    "text_filter": text_filter,
    "anti_filter": anti_filter,
    "moved_rows": moved_rows,
    "pairs": pairs,
    "id_or_name": id_or_name,
    "first_match": first_match,
    "key_union": key_union,
    "bag_union": bag_union,
    "override_column": override_column,
    "managed_with_component": managed_with_component,
    "same_rows": same_rows,
}

ORACLE = {
    "semi_filter": """
WITH listed AS (
  SELECT s_suppkey AS k FROM supplier UNION SELECT s_suppkey + 3 FROM supplier
  UNION SELECT CAST(trunc(s_acctbal / 10) AS BIGINT) FROM supplier)
SELECT o_orderkey, 'cust/' || CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey IN (SELECT k FROM listed)""",
    "text_filter": """
SELECT o_orderkey, 'p/' || substr(o_orderpriority, 3) AS priority FROM orders
WHERE substr(o_orderpriority, 3) IN ('URGENT', 'LOW')""",
    "anti_filter": """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""",
    "moved_rows": """
SELECT l_orderkey AS id, l_linestatus AS status, l_linenumber FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> l_linestatus)""",
    "pairs": "SELECT s_suppkey, s_name, target FROM supplier, (VALUES ('dev'), ('test'), ('prod')) t(target)",
    "id_or_name": """
WITH q AS (SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 2 END AS asked_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN substr(o_orderpriority, 1, 1) END AS asked_name FROM orders),
names AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, min(c_custkey) AS k FROM customer WHERE c_nationkey < 4 GROUP BY 1)
SELECT o_orderkey,
  CASE WHEN i.c_custkey IS NOT NULL THEN 'c/' || CAST(i.c_custkey AS VARCHAR)
       WHEN n.k IS NOT NULL THEN 'c/' || CAST(n.k AS VARCHAR) END AS match_id,
  CASE WHEN i.c_custkey IS NOT NULL THEN CASE WHEN i.c_nationkey < 4 THEN CAST(i.c_nationkey AS VARCHAR) END
       ELSE n.name END AS match_name
FROM q LEFT JOIN customer i ON i.c_custkey = q.asked_id LEFT JOIN names n ON n.name = q.asked_name""",
    "first_match": """
SELECT c_custkey, c_name, f.o_orderpriority FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderpriority FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) f ON o_custkey = c_custkey""",
    "key_union": """
SELECT c_nationkey AS nation, c_mktsegment AS kind FROM customer
UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier""",
    "bag_union": """
SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0""",
    "override_column": """
SELECT c_custkey, CASE WHEN s_acctbal > 3000 THEN 's' || CAST(s_nationkey AS VARCHAR)
                       ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "managed_with_component": """
SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "same_rows": """
WITH f AS (SELECT * FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  l.l_returnflag = f.l_returnflag AND l.l_linestatus = f.l_linestatus AND l.l_tax = f.l_tax
  AND l.l_discount = f.l_discount AND l.l_quantity = f.l_quantity AS same
FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey""",
}
