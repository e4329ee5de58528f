"""Queries of nested and JSON values, over job documents made up from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.functions import nested
from pipelinekit.functions.text import jar_version


def _jobs(spark, sf_dir):
    """A job document per order: two processes, the second one's reference as a literal."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    subscribed = F.concat(
        F.lit("gitUri=http://git/a.git&subPath=&tag=Hello/x-1.0&projectSubscriptionProjectId="),
        customer, F.lit("&path=pipelines/p"),
    )
    reference = F.when(key % 3 == 0, subscribed).otherwise(F.concat(F.lit("pipelines/p"), customer))

    def process(component, reference, size):
        return F.struct(
            component.alias("component"), F.struct(reference.alias("pipelineId"), size.alias("clusterSize")).alias("properties")
        )

    literal = F.struct(F.when(key % 2 == 0, "literal").otherwise("expression").alias("type"), reference.alias("value"))
    first = process(
        F.when(F.col("o_orderstatus") == "F", "Script").otherwise("Pipeline"),
        F.concat(F.lit("pipelines/s"), F.substring("o_orderpriority", 1, 1)),
        F.when(key % 4 != 1, F.concat(F.lit("f"), (key % 6).cast("string"), F.lit("/small"))),
    )
    second = process(F.lit("Pipeline"), literal, F.lit("f9"))
    document = F.to_json(F.struct(F.struct(first.alias("p1"), second.alias("p2")).alias("processes")))
    return table(spark, sf_dir, "orders").select("o_orderkey", document.alias("document"))


def json_refs(spark, sf_dir):
    """A document per order in one of eight shapes, each with a project of its own to find or to pass over."""
    key = F.col("o_orderkey")
    project = F.col("o_custkey") * 10 + key % 8
    name = F.concat(F.lit("gitUri=http://git/a.git&subPath=&tag=Hello/x-1.0&projectSubscriptionProjectId="), project, F.lit("&path=pipelines/p"))
    shapes = [
        '{"a": {"b": [{"c": [[{"pipelineId": "REF"}]]}]}}',
        '[1, "pipelineId", {"x": null}, {"pipelineId": "REF", "y": {}}]',
        r'{"note": "{\"pipelineId\": \"REF9\"}", "pipelineId": "REF", "pipelineIds": "REF8"}',
        '{"pipelineId": 5, "more": [{"pipelineId": null}, {"pipelineId": "REF"}]}',
        '{"pipelineId": {"type": "expression", "value": "REF"}}',
        '{"pipelineId": {"a": {"x": {}}, "type": "literal", "value": "REF", "z": [{}, "}"]}}',
        '{"pipelineId": {"inner": {"pipelineId": "REF"}, "type": "literal", "value": {"value": "REF"}}}',
        '{"pipelineId": "REF"',
    ]
    shape = F.element_at(F.array(*map(F.lit, shapes)), (key % 8 + 1).cast("int"))
    return nested.json_refs(table(spark, sf_dir, "orders").select(F.replace(shape, F.lit("REF"), name).alias("document")), "document")


def json_entities(spark, sf_dir):
    return nested.entities_of_kind(_jobs(spark, sf_dir), "document", "Pipeline")


def json_places(spark, sf_dir):
    return nested.entity_places(_jobs(spark, sf_dir), ["o_orderkey"], "document")


def rewrite_items(spark, sf_dir):
    """Wheels of each part turned into package requirements from a private index."""
    size = F.col("p_size")
    suffix = F.when(size % 5 == 0, ".zip").otherwise("-py3-none-any.whl")
    wheel = F.concat(F.lit("dbfs:/x/pipeline/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("-1."), size, suffix)

    def library(whl, package):
        pypi = F.when(package.isNotNull(), F.struct(package.alias("package"), F.lit(None).cast("string").alias("repo")))
        return F.struct(whl.cast("string").alias("whl"), pypi.alias("pypi"))

    libraries = F.array(library(F.lit(None), F.lit("libs==1.9")), library(wheel, F.lit(None).cast("string")))
    part = table(spark, sf_dir, "part").select("p_partkey", libraries.alias("libraries"))
    rewritten = part.withColumn("libraries", nested.wheels_to_packages(F.col("libraries"), "https://index/"))
    return rewritten.select("p_partkey", F.posexplode("libraries")).select(
        "p_partkey", F.col("pos").alias("position"), "col.whl", "col.pypi.package", "col.pypi.repo"
    )


def any_component(spark, sf_dir):
    """Whether a document has a process of a kind, asked of a map of processes."""
    processes = F.from_json("document", nested.JOB).getField("processes")
    return _jobs(spark, sf_dir).select("o_orderkey", nested.has_component(processes, "Script").alias("has_script"))


def items_allowed(spark, sf_dir):
    """The words of a part's name and type that are in an allowed list."""
    words = F.concat(F.split("p_name", " "), F.array("p_type"), F.split("p_name", " "))
    allowed = F.array(*[F.lit(w) for w in ("small", "red", "widget", "ECONOMY")])
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(nested.items_allowed(words, allowed), " ").alias("words")
    )


def _components(spark, sf_dir):
    """One-field structs per order: a script for finished ones, a model for urgent ones."""
    def item(script, model):
        return F.struct(script.cast("string").alias("script"), model.cast("string").alias("model"))

    none = F.lit(None)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(
            item(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("s"), "o_custkey")), none),
            item(none, F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("m"), "o_custkey"))),
            item(F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("extra")), none),
        ).alias("components"),
    )


def _joined(df):
    return df.withColumn("components", F.array_join("components", ","))


def components_kept(spark, sf_dir):
    return _joined(nested.components_of_kind(_components(spark, sf_dir), "components", "script", drop_empty=False))


def components_dropped(spark, sf_dir):
    return _joined(nested.components_of_kind(_components(spark, sf_dir), "components", "model", drop_empty=True))


def any_flag(spark, sf_dir):
    """Whether any event has one of several properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    return nested.any_flag(
        table(spark, sf_dir, "events"),
        {"any_error": (F.col("event_type") == "error") | (k > 98), "any_over": k > 100, "any_given": F.get_json_object("props", "$.k") == "26"},
    )


def drop_nulls(spark, sf_dir):
    """A nested value per order with nulls at every depth, as JSON without them."""
    key = F.col("o_orderkey")
    maybe = F.when(key % 2 == 0, F.col("o_orderstatus"))
    inner = F.struct(maybe.alias("a"), F.array(F.lit("x"), maybe, F.lit("y")).alias("b"))
    value = F.struct(
        F.when(key % 3 == 0, F.lit("top")).alias("t"),
        F.array(inner, F.when(key % 5 == 0, inner)).alias("items"),
        F.create_map(F.lit("k"), maybe, F.lit("l"), F.lit("1")).alias("m"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return orders.select("o_orderkey", nested.drop_nulls_json(F.col("value"), orders.schema["value"].dataType).alias("json"))


def task_versions(spark, sf_dir):
    """Language versions each brand is built for: a part's components matched with its tasks."""
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))

    def component(node, entity):
        return F.struct(node.alias("node"), entity.alias("entity"))

    def task(key, *files):
        return F.struct(F.lit(key).alias("task_key"), F.array(*files).alias("files"))

    node = F.when(F.col("p_size") % 4 == 0, "none").otherwise("n1")
    rows = table(spark, sf_dir, "part").select(
        F.array(component(node, F.col("p_brand")), component(F.lit("n2"), F.col("p_type"))).alias("components"),
        F.array(
            task("n1", F.concat(name, F.lit("_2.12.jar")), F.concat(name, F.lit(".jar"))),
            task("n2", F.concat(name, F.when(F.col("p_size") > 25, "_2.13.jar").otherwise("_2.12.jar"))),
        ).alias("tasks"),
    )
    return nested.task_versions(rows, "components", "tasks", jar_version)


QUERIES = {
    "json_refs": json_refs,
    "json_entities": json_entities,
    "json_places": json_places,
    "rewrite_items": rewrite_items,
    "any_component": any_component,
    "items_allowed": items_allowed,
    "components_kept": components_kept,
    "components_dropped": components_dropped,
    "any_flag": any_flag,
    "drop_nulls": drop_nulls,
    "task_versions": task_versions,
}

_REFERENCE = """
  CASE WHEN o_orderkey % 3 = 0 THEN 'gitUri=http://git/a.git&subPath=&tag=Hello/x-1.0&projectSubscriptionProjectId='
       || CAST(o_custkey AS VARCHAR) || '&path=pipelines/p' ELSE 'pipelines/p' || CAST(o_custkey AS VARCHAR) END"""

ORACLE = {
    "json_refs": """
SELECT DISTINCT CAST(o_custkey * 10 + o_orderkey % 8 AS VARCHAR) AS project_id FROM orders WHERE o_orderkey % 8 IN (0, 1, 2, 3, 5)""",
    "json_entities": f"""
SELECT 'pipelines/s' || substr(o_orderpriority, 1, 1) AS entity FROM orders WHERE o_orderstatus <> 'F'
UNION SELECT {_REFERENCE} FROM orders WHERE o_orderkey % 2 = 0""",
    "json_places": f"""
SELECT o_orderkey, 'pipelines/s' || substr(o_orderpriority, 1, 1) AS entity, 'f' || CAST(o_orderkey % 6 AS VARCHAR) AS place
FROM orders WHERE o_orderkey % 4 <> 1
UNION ALL SELECT o_orderkey, {_REFERENCE}, 'f9' FROM orders WHERE o_orderkey % 2 = 0""",
    "rewrite_items": """
SELECT p_partkey, 0 AS position, NULL AS whl, 'libs==1.9' AS package, NULL AS repo FROM part
UNION ALL SELECT p_partkey, 1,
  CASE WHEN p_size % 5 = 0 THEN 'dbfs:/x/pipeline/' || replace(p_name, ' ', '_') || '-1.' || CAST(p_size AS VARCHAR) || '.zip' END,
  CASE WHEN p_size % 5 <> 0 THEN replace(p_name, ' ', '_') || '==1.' || CAST(p_size AS VARCHAR) END,
  CASE WHEN p_size % 5 <> 0 THEN 'https://index/simple' END FROM part""",
    "any_component": "SELECT o_orderkey, o_orderstatus = 'F' AS has_script FROM orders",
    "items_allowed": """
SELECT p_partkey, array_to_string(list_filter(list_concat(string_split(p_name, ' '), [p_type], string_split(p_name, ' ')),
       lambda w: w IN ('small', 'red', 'widget', 'ECONOMY')), ' ') AS words FROM part""",
    "components_kept": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 's' || CAST(o_custkey AS VARCHAR) ELSE '' END
  || CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN ',' ELSE '' END
  || CASE WHEN o_orderpriority = '2-HIGH' THEN 'extra' ELSE '' END AS components FROM orders""",
    "components_dropped": """
SELECT o_orderkey, 'm' || CAST(o_custkey AS VARCHAR) AS components FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "any_flag": r"""
WITH e AS (SELECT event_type, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events)
SELECT bool_or(event_type = 'error' OR k > 98) AS any_error, bool_or(k > 100) AS any_over, bool_or(k = 26) AS any_given FROM e""",
    "drop_nulls": """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
p AS (SELECT k, s, CASE WHEN k % 2 = 0 THEN '{"a":"' || s || '","b":["x","' || s || '","y"]}' ELSE '{"b":["x","y"]}' END AS i FROM o)
SELECT k AS o_orderkey, '{' || CASE WHEN k % 3 = 0 THEN '"t":"top",' ELSE '' END || '"items":[' || i
  || CASE WHEN k % 5 = 0 THEN ',' || i ELSE '' END || '],"m":{'
  || CASE WHEN k % 2 = 0 THEN '"k":"' || s || '",' ELSE '' END || '"l":"1"}}' AS json FROM p""",
    "task_versions": """
SELECT p_brand AS entity, '2.12' AS version FROM part WHERE p_size % 4 <> 0
UNION SELECT p_type, CASE WHEN p_size > 25 THEN '2.13' ELSE '2.12' END FROM part""",
}
