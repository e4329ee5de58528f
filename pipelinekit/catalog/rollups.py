"""Queries of the roll-ups, routing and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.operators import checks
from pipelinekit.operators import rollups as ops
from pipelinekit.operators.routing import route
from pipelinekit.operators.running import in_lists


def distinct_values(spark, sf_dir):
    """The distinct suppliers of returned lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("supplier")).dropna().distinct()


def value_sets(spark, sf_dir):
    """The suppliers of each part, sorted, in lists of five."""
    sets = ops.value_sets(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")
    lists = in_lists(sets, ["l_partkey"], F.col("l_suppkey").cast("string"), 5, "suppliers")
    return lists.withColumn("suppliers", F.array_join("suppliers", ","))


def invert_mapping(spark, sf_dir):
    """Lines mapped to a part and a supplier, turned into parts and suppliers with lists of a hundred lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"),
        F.array(
            F.struct(F.concat(F.lit("part-"), "l_partkey").alias("child"), F.col("l_returnflag").alias("attr")),
            F.struct(F.concat(F.lit("supp-"), "l_suppkey").alias("child"), F.col("l_linestatus").alias("attr")),
        ).alias("children"),
    )
    lists = in_lists(ops.invert(lines, "line", "children"), ["child"], F.concat_ws(":", "parent", "attr"), 100, "parents")
    return lists.withColumn("parents", F.array_join("parents", ","))


def severity_rollup(spark, sf_dir):
    """Errors and, as warnings, sign-ups of each user; both break a user."""
    severity = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2)
    item = F.struct(severity.alias("severity"), F.col("props").alias("message"))
    events = table(spark, sf_dir, "events").select("user_id", F.array(item, item).alias("diagnostics"))
    return ops.severity_rollup(events, ["user_id"], "diagnostics", warnings_as_errors=True)


def step_status(spark, sf_dir):
    """Status per user and kind of event, from return codes read from the properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.when(k < 60, 0).when(k < 95, 5).otherwise(1)
    return ops.step_status(table(spark, sf_dir, "events"), ["user_id", "event_type"], ~ops.succeeded(code))


def last_per_key(spark, sf_dir):
    """The storage base of each customer's latest order kept on a volume."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    root = F.when(status == "O", F.lit("/Volumes/v")).when(status == "F", F.lit("dbfs:/Volumes/w")).otherwise("dbfs:/plain")
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", key, F.concat(root, (key % 7).cast("string"), F.lit("/artifacts/"), key.cast("string")).alias("path")
    )
    return ops.last_base_path(orders, "o_custkey", "path", "o_orderkey", ["/Volumes", "dbfs:/Volumes"], "/artifacts/")


def fingerprint(spark, sf_dir):
    """Fingerprint of each conversation without its system turns."""
    turns = table(spark, sf_dir, "conversations").withColumn("name", F.lpad(F.col("turn").cast("string"), 6, "0"))
    return ops.fingerprint(turns, ["conv_id"], "name", "text", keep=F.col("role") != "system")


def route_rows(spark, sf_dir):
    """Documents without a label set apart, the others by language, length and blankness."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = documents.join(labels.select("doc_id", "quality"), "doc_id", "left")
    rules = [
        ("language", ~F.col("lang").isin("en", "de")),
        ("too short", F.length("text") < 200),
        ("low quality", F.col("quality") == 0),
    ]
    routed = route(labelled, rules, incomplete=F.col("quality").isNull())
    return routed.select("doc_id", "status", "reason")


def _perturbed(spark, sf_dir):
    """Orders, and a copy with some rows dropped, repeated, changed a little or a lot."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    changed = F.when(priority == "2-HIGH", price + 0.25).when(priority == "3-MEDIUM", price + 2).otherwise(price)
    copy = orders.filter("o_orderpriority <> '5-LOW' OR o_orderstatus <> 'P'").withColumn("o_totalprice", changed)
    return orders, copy.unionByName(copy.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"))


def frame_diff(spark, sf_dir):
    return checks.frame_diff(*_perturbed(spark, sf_dir), ["o_orderkey", "o_orderstatus", "o_totalprice"])


def frame_diff_tolerant(spark, sf_dir):
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    diff = checks.frame_diff(*_perturbed(spark, sf_dir), cols, keys=["o_orderkey"], tolerance=1.0)
    return diff.select("o_orderkey", "side", "left_o_orderstatus", "right_o_orderstatus")


def row_predicates(spark, sf_dir):
    return checks.row_predicates(
        table(spark, sf_dir, "orders"),
        {
            "positive": "o_totalprice > 0",
            "not_urgent": F.col("o_orderpriority") != "1-URGENT",
            "cheap": "o_totalprice < 100000",
            "finished_is_low": "if(o_orderstatus = 'F', o_orderpriority = '5-LOW', null)",
        },
    )


def observed_metrics(spark, sf_dir):
    """Row and null counts of a join, observed while its result is computed."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ordered = table(spark, sf_dir, "orders").groupBy("o_custkey").count()
    joined = customer.join(ordered, F.col("c_custkey") == F.col("o_custkey"), "left")
    watched, observation = checks.observed(joined, "customers", ["o_custkey", "c_mktsegment"])
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(
        [(name, int(value)) for name, value in observation.get.items()], "metric string, value long"
    )


QUERIES = {
    "distinct_values": distinct_values,
    "value_sets": value_sets,
    "invert_mapping": invert_mapping,
    "severity_rollup": severity_rollup,
    "step_status": step_status,
    "last_per_key": last_per_key,
    "fingerprint": fingerprint,
    "route_rows": route_rows,
    "frame_diff": frame_diff,
    "frame_diff_tolerant": frame_diff_tolerant,
    "row_predicates": row_predicates,
    "observed_metrics": observed_metrics,
}

_COPY = """
o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
c AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS p,
        CASE o_orderpriority WHEN '2-HIGH' THEN o_totalprice + CAST(0.25 AS DOUBLE)
             WHEN '3-MEDIUM' THEN o_totalprice + CAST(2 AS DOUBLE) ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderstatus <> 'P'),
cc AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM c
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM c WHERE p = '1-URGENT' AND o_orderstatus = 'O')"""

ORACLE = {
    "distinct_values": "SELECT DISTINCT l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R'",
    "value_sets": """
WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS pos FROM d)
SELECT l_partkey, CAST((pos - 1) // 5 AS INTEGER) AS chunk,
       string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY pos) AS suppliers FROM r GROUP BY 1, 2""",
    "invert_mapping": """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line, * FROM lineitem),
p AS (SELECT 'part-' || CAST(l_partkey AS VARCHAR) AS child, line, l_returnflag AS attr FROM l
      UNION ALL SELECT 'supp-' || CAST(l_suppkey AS VARCHAR), line, l_linestatus FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY line, attr) AS pos FROM p)
SELECT child, CAST((pos - 1) // 100 AS INTEGER) AS chunk,
       string_agg(line || ':' || attr, ',' ORDER BY pos) AS parents FROM r GROUP BY 1, 2""",
    "severity_rollup": """
SELECT user_id, CAST(2 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS num_errors,
       CAST(2 * sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS num_warnings,
       bool_or(event_type IN ('error', 'signup')) AS is_broken FROM events GROUP BY user_id""",
    "step_status": r"""
WITH e AS (SELECT user_id, event_type, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events)
SELECT user_id, event_type, CASE WHEN bool_or(k >= 95) THEN 'FAILED' ELSE 'SUCCEEDED' END AS status
FROM e GROUP BY 1, 2""",
    "last_per_key": """
SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN '/Volumes/v' ELSE 'dbfs:/Volumes/w' END
       || CAST(o_orderkey % 7 AS VARCHAR) AS base_path
FROM orders WHERE o_orderstatus IN ('O', 'F')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "fingerprint": f"""
SELECT conv_id, sha256(coalesce(string_agg(text, '$$$' ORDER BY turn) FILTER (WHERE role <> 'system'), '')
       || '{ops.SALT}') AS fingerprint FROM conversations GROUP BY conv_id""",
    "route_rows": """
SELECT d.doc_id,
  CASE WHEN quality IS NULL THEN 'incomplete' WHEN lang NOT IN ('en', 'de') OR length(text) < 200 OR quality = 0
       THEN 'invalid' ELSE 'valid' END AS status,
  CASE WHEN quality IS NULL THEN 'incomplete' WHEN lang NOT IN ('en', 'de') THEN 'language'
       WHEN length(text) < 200 THEN 'too short' WHEN quality = 0 THEN 'low quality' END AS reason
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "frame_diff": f"""
WITH {_COPY}, s AS (SELECT *, 1 AS n FROM o UNION ALL SELECT *, -1 FROM cc)
SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN sum(n) > 0 THEN 'left' ELSE 'right' END AS side,
       CAST(abs(sum(n)) AS BIGINT) AS copies
FROM s GROUP BY 1, 2, 3 HAVING sum(n) <> 0""",
    "frame_diff_tolerant": f"""
WITH {_COPY},
a AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice) AS pos FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_totalprice) AS pos FROM cc)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN b.pos IS NULL THEN 'left' WHEN a.pos IS NULL THEN 'right' ELSE 'both' END AS side,
  a.o_orderstatus AS left_o_orderstatus, b.o_orderstatus AS right_o_orderstatus
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey AND a.pos = b.pos
WHERE a.pos IS NULL OR b.pos IS NULL OR abs(a.o_totalprice - b.o_totalprice) > 1""",
    "row_predicates": """
SELECT count(*) FILTER (WHERE NOT o_totalprice > 0) AS positive,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS not_urgent,
       count(*) FILTER (WHERE NOT o_totalprice < 100000) AS cheap,
       count(*) FILTER (WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')) AS finished_is_low FROM orders""",
    "observed_metrics": """
SELECT 'rows' AS metric, count(*) AS value FROM customer
UNION ALL SELECT 'o_custkey_nulls', count(*) FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'c_mktsegment_nulls', count(*) - count(c_mktsegment) FROM customer""",
}
