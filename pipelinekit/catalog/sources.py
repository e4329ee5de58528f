"""Queries that write a sample table to the shared folder and read it back by spec."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.functions.nested import flatten
from pipelinekit.operators.running import numbered
from pipelinekit.sources import DatasetSpec, read, write
from pipelinekit.storage import scratch_path

TRIMMED = {
    "separator": ",",
    "header": True,
    "ignoreLeadingWhiteSpaceReading": True,
    "ignoreTrailingWhiteSpaceReading": True,
    "ignoreLeadingWhiteSpaceWriting": True,
    "ignoreTrailingWhiteSpaceWriting": True,
    "nullValue": None,
}

ORDERS = {
    "order_id": "long",
    "customer_id": "long",
    "order_status": "string",
    "order_category": "string",
    "order_date": "string",
    "amount": "double",
}


def _schema(columns):
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("order_status"),
        F.col("o_orderpriority").alias("order_category"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
        F.col("o_totalprice").alias("amount"),
    )


def _stored(df, options, schema=None, fmt="csv", partition_by=()):
    """Write a table, and the spec to read it back with."""
    spark = df.sparkSession
    spec = DatasetSpec(fmt, scratch_path(spark, fmt), options, schema, "overwrite", partition_by)
    write(df, spec)
    return spec


def csv_roundtrip(spark, sf_dir):
    """Fixed schema, with blanks around a value trimmed."""
    return read(spark, _stored(_orders(spark, sf_dir), TRIMMED, _schema(ORDERS)))


def csv_untrimmed_strings(spark, sf_dir):
    """All columns as strings, blanks kept on both ways."""
    options = {
        "separator": "|", "header": True,
        "ignoreLeadingWhiteSpaceWriting": False, "ignoreTrailingWhiteSpaceWriting": False,
    }
    strings = _schema(dict.fromkeys(ORDERS, "string"))
    df = _orders(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return read(spark, _stored(df, options, strings))


def csv_header_names(spark, sf_dir):
    """No schema: names from the header, everything a string."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return read(spark, _stored(df, TRIMMED))


def csv_schema_over_inference(spark, sf_dir):
    """A fixed schema together with ``inferSchema``: the schema wins."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    schema = "c_custkey string, c_nationkey string"
    return read(spark, _stored(df, {**TRIMMED, "inferSchema": True}, schema))


def short_schema_read(spark, sf_dir):
    """A schema with three of the file's columns reads the first three."""
    return read(spark, _stored(_orders(spark, sf_dir), TRIMMED, _schema(dict(list(ORDERS.items())[:3]))))


def parquet_roundtrip(spark, sf_dir):
    """The schema comes with the files; stored in folders by segment."""
    spec = _stored(table(spark, sf_dir, "customer"), {"mergeSchema": None}, fmt="parquet", partition_by=["c_mktsegment"])
    return read(spark, spec).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


DOCUMENT = (
    "result struct<count: string, events: array<struct<category1: string, category2: string, `date`: string, "
    "description: string, granularity: string, lang: string>>>"
)


def _documents(df):
    """One nested document per row: each row's date and type as a list of two events."""
    def event(category, description):
        return F.struct(
            category.alias("category1"), F.lit("by").alias("category2"), F.col("day").alias("date"),
            description.alias("description"), F.lit("day").alias("granularity"), F.lit("en").alias("lang"),
        )

    events = F.array(event(F.col("kind"), F.col("id")), event(F.lit("all"), F.col("id")))
    return df.select(F.struct(F.lit("2").alias("count"), events.alias("events")).alias("result"))


FLAT = [f"result-events-{name}" for name in ("category1", "category2", "date", "description")]


def _flat(df):
    """Flattened documents, written as JSON lines and read back; hyphens become underscores."""
    spark = df.sparkSession
    schema = _schema(dict.fromkeys(FLAT, "string"))
    lines = read(spark, _stored(flatten(df, FLAT), {"ignoreNullFields": None}, schema, "json"))
    return lines.select(*[F.col(f"`{name}`").alias(name.replace("-", "_")) for name in FLAT])


def json_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("date").cast("string").alias("day"),
    )
    spec = _stored(_documents(events), {}, DOCUMENT, "json")
    return _flat(read(spark, spec))


PER_FILE = 1000  # documents of a file at most; a reader holds one file's at a time


def json_documents(spark, sf_dir):
    """Documents over several lines, many to a file, which is one array: opening a file per document would take most of the time."""
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("kind"),
        F.lit("2024-01-01").alias("day"),
    )
    path = scratch_path(spark, "documents")
    # Consecutive rows of a partition go together, whatever their values.
    part = F.floor(F.monotonically_increasing_id() / PER_FILE)
    files = _documents(supplier).withColumn("part", part).groupBy("part").agg(F.collect_list(F.struct("result")).alias("documents"))
    files.select(F.to_json("documents", {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return _flat(read(spark, DatasetSpec("json", path, {"multiLine": True}, DOCUMENT)))


def write_once(spark, sf_dir):
    """Written with the mode unset, then with mode ``error``, to folders that do not exist yet."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    specs = [DatasetSpec("parquet", scratch_path(spark, "once"), {}, "c_custkey long, c_name string", mode) for mode in (None, "error")]
    for spec in specs:
        write(rows, spec)
    return read(spark, specs[0]).unionByName(read(spark, specs[1]))


def sorted_report(spark, sf_dir):
    """A sorted table written to files; the order shows in file name and line."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    spec = _stored(df.orderBy(F.col("balance").desc(), "c_custkey"), TRIMMED, "id long, balance double")
    place = ["file_name", "file_block_start"]
    found = read(spark, spec).select("id", "balance", *[F.col(f"_metadata.{c}") for c in place])
    lines = found.withColumn("line", F.monotonically_increasing_id())  # in order within a block of a file
    return numbered(lines, [], [*place, "line"]).select("position", "id", "balance")


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "csv_untrimmed_strings": csv_untrimmed_strings,
    "csv_header_names": csv_header_names,
    "csv_schema_over_inference": csv_schema_over_inference,
    "short_schema_read": short_schema_read,
    "parquet_roundtrip": parquet_roundtrip,
    "json_flatten": json_flatten,
    "json_documents": json_documents,
    "sorted_report": sorted_report,
    "write_once": write_once,
}

_ORDERS = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
       o_orderpriority AS order_category, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
       o_totalprice AS amount FROM orders"""


def _flat_sql(source: str, kind: str, day: str, key: str) -> str:
    def part(category):
        return f"""
SELECT {category} AS result_events_category1, 'by' AS result_events_category2,
       {day} AS result_events_date, CAST({key} AS VARCHAR) AS result_events_description FROM {source}"""

    return f"{part(kind)} UNION ALL {part(chr(39) + 'all' + chr(39))}"


ORACLE = {
    "csv_roundtrip": _ORDERS,
    "csv_untrimmed_strings": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       '  ' || o_orderstatus || ' ' AS order_status, o_orderpriority AS order_category,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders""",
    "csv_header_names": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer",
    "csv_schema_over_inference": """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""",
    "short_schema_read": f"SELECT order_id, customer_id, order_status FROM ({_ORDERS})",
    "parquet_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
    "json_flatten": _flat_sql("events", "event_type", "CAST(CAST(ts AS DATE) AS VARCHAR)", "event_id"),
    "json_documents": _flat_sql("supplier", "s_name", "'2024-01-01'", "s_suppkey"),
    "write_once": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer",
    "sorted_report": """
SELECT row_number() OVER (ORDER BY CAST(c_acctbal AS DECIMAL(18,2)) DESC, c_custkey) AS position,
       c_custkey AS id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer""",
}
