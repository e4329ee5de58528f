"""Queries of the text helpers and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.functions import text, versions
from pipelinekit.functions.nested import document_references
from pipelinekit.functions.registry import register_functions


def reference_fields(spark, sf_dir):
    """References made up from lines, some without a path or without a second tag part."""
    key = F.col("l_orderkey")
    uri = F.concat(
        F.lit("gitUri=http://git/"), "l_partkey", F.lit(".git&subPath="), "l_returnflag",
        F.lit("&tag="), F.when(key % 5 == 0, "plain").otherwise(F.concat(F.lit("Hello/"), "l_linestatus", F.lit("-1.0."), "l_linenumber")),
        F.lit("&projectSubscriptionProjectId="), "l_suppkey",
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("&path=jobs/"), key)),
    )
    fields = text.reference_fields(F.col("reference"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", uri.alias("reference"))
    return lines.select("l_orderkey", "l_linenumber", fields.alias("f")).select("l_orderkey", "l_linenumber", "f.*")


def package_parts(spark, sf_dir):
    """Package names and versions out of wheel paths; the language version out of jar names."""
    part = table(spark, sf_dir, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    size = F.col("p_size").cast("string")
    wheel = F.concat(F.lit("dbfs:/dev/pipeline/"), name, F.lit("-1."), size, F.when(F.col("p_size") < 40, "-py3-none-any.whl").otherwise(".zip"))
    jar = F.concat(name, F.lit("_2."), F.when(F.col("p_size") % 3 == 0, "11").when(F.col("p_size") % 3 == 1, "12").otherwise("13"), F.lit(".jar"))
    return part.select(
        "p_partkey",
        text.package_parts(wheel).getField("name").alias("package"),
        text.package_parts(wheel).getField("version").alias("version"),
        text.jar_version(jar).alias("jar_version"),
    )


def normalise_name(spark, sf_dir):
    """Whole document texts as names."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_name(F.col("text")).alias("name"))


def sql_functions(spark, sf_dir):
    """The registered functions called from SQL text."""
    register_functions(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("part_names")
    return spark.sql("""
        SELECT p_partkey, short_hash(p_name) AS hash, normalise_name(concat(p_name, '--', p_type)) AS name,
          strip_prefix(p_brand, 'Brand#') AS brand, strip_prefix(p_name, substr(p_name, 1, 3)) AS shorter,
          is_blank(repeat(' ', p_size) || substr(p_type, 1, p_size % 2)) AS blank,
          jar_version(concat(p_name, '_2.1', 2 + p_partkey % 3, '.jar')) AS jar,
          package_parts(concat('x/pipeline/', p_type, '-1.', p_size, '-py3-none-any.whl')).version AS package,
          reference_fields(concat('gitUri=', p_brand, '&subPath=&tag=', p_type, '/', p_size, '&projectSubscriptionProjectId=', p_partkey, '&path=p')) AS fields,
          bucket_of(path, 's3://') AS bucket, prefix_of(path, 's3://') AS rest, part_behind(path, '://', 2) AS part
        FROM (SELECT *, concat('s3://', p_brand, '/', p_name, '/', p_type) AS path FROM part_names)
    """).select("*", "fields.git_uri", "fields.tag", "fields.project_id").drop("fields")


PLACEHOLDERS = {"{{PROJECT}}": "17", "{{VERSION}}": "1.0", "{{TAG}}": "Hello/1.0", "{{URL}}": "http://x/{{PROJECT}}"}


def substitute(spark, sf_dir):
    """Placeholders appended to whole texts, replaced in files of three types only."""
    key = F.col("doc_id")
    name = F.concat(F.lit("f"), key, F.when(key % 4 == 0, ".json").when(key % 4 == 1, ".py").when(key % 4 == 2, ".scala").otherwise(".md"))
    body = F.concat("text", F.lit(" {{PROJECT}}/{{TAG}} {{URL}} {{VERSION}}$1"))
    return table(spark, sf_dir, "documents").select("doc_id", text.substitute(name, body, PLACEHOLDERS).alias("text"))


def path_parts(spark, sf_dir):
    """Bucket and prefix of page addresses, and the first part behind the host's marker."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.bucket_of(url, "https://").alias("bucket"),
        text.prefix_of(url, "https://").alias("prefix"),
        text.part_behind(url, ".com/", 1).alias("part"),
        text.strip_prefix(url, "http://").alias("stripped"),
        text.is_blank(F.regexp_replace("url", "[^#]", " ")).alias("no_fragment"),
    )


def short_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.short_hash(F.col("text")).alias("hash"))


OLD, NEW = "pipelines/orders", "pipelines/sales"


def stale_text(spark, sf_dir):
    """Files of several types around whole document texts, judged for an old reference; job documents name it in eight ways."""
    key = F.col("doc_id")
    path = F.element_at(
        F.array(
            *[F.lit(p) for p in (
                "pipelines/a/code/m.py", "jobs/j/code/dag.py", "pipelines/a/code/c.yml", "pipelines/a/code/x.json",
                "pipelines/a/code/build/m.py", "jobs/j/code/job.json", "notes.md", "p/code/.v/workflow.latest.json",
            )]
        ),
        (key % 8 + 1).cast("int"),
    )
    refers = (
        F.when(key % 5 == 0, F.lit(f' "{OLD}" '))
        .when(key % 5 == 1, F.lit(f" {OLD} "))
        .when(key % 5 == 2, F.lit(f" x{OLD}s "))
        .when(key % 5 == 3, F.lit(f' "{OLD}" and {NEW}'))
        .otherwise(F.lit(""))
    )
    uri = F.when(key % 5 == 0, OLD).when(key % 5 == 1, f"{OLD}2").when(key % 5 == 2, f"{OLD}/{NEW}").otherwise("other")
    jobs = [
        '{"processes": {"p": {"properties": {"pipelineId": "URI"}}, "q": "text"}, "note": NOTE}',
        '{"processes": {"p": {"properties": {"pipelineId": {"type": "expression", "value": "URI"}}}}, "note": NOTE}',
        '{"processes": {"p": {"properties": {"pipelineId": 5}}}, "also": "URI", "note": NOTE}',
        '{"components": [{"x": 1}, {"PipelineComponent": {"pipelineId": "URI"}}], "note": NOTE}',
        '{"components": [{"PipelineComponent": {"pipelineId": {"value": "URI"}}}], "note": NOTE}',
        '{"components": [], "request": {"CreateNewJobRequest": {"tasks": [{}, {"libraries": [{"PipelineComponent": {"pipelineId": "URI"}}]}]}}, "note": NOTE}',
        '{"components": [], "request": {"tasks": [{"libraries": [{"y": 1}, {"PipelineComponent": {"pipelineId": "URI"}}]}]}, "note": NOTE}',
        '{"request": {"tasks": [{"libraries": [{"PipelineComponent": {"pipelineId": "URI"}}]}]}, "note": NOTE}',
        '{"processes": {"p": {"properties": "URI"}}, "note": NOTE}',
    ]
    shape = F.element_at(F.array(*map(F.lit, jobs)), (F.floor(key / 8) % 9 + 1).cast("int"))
    # The note holds the old name where the document itself holds another: it counts only where a document can't be read.
    note = F.get_json_object(F.to_json(F.struct(F.array(F.concat("text", F.when(key % 5 == 4, OLD).otherwise(""))).alias("n"))), "$.n")
    job = F.replace(F.replace(shape, F.lit("URI"), uri), F.lit("NOTE"), F.coalesce(note, F.lit("null")))
    workflow = F.to_json(F.struct(F.struct(uri.alias("uri")).alias("metainfo"), F.col("text").alias("note")))
    body = F.when(key % 8 == 5, job).when(key % 8 == 7, workflow).otherwise(F.concat("text", refers))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), body.alias("body"))
    stale = text.is_stale(F.col("path"), F.col("body"), OLD, NEW, document_references(F.col("path"), F.col("body")))
    return files.select("doc_id", "path", stale.alias("stale"))


def _versions(spark, sf_dir):
    """A version per part: numbers from its size and key, some with a pre-release, some broken."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = F.concat_ws(".", size % 12, (key / 7).cast("int") % 15, key % 11)
    version = (
        F.when(key % 10 == 0, F.concat(number, F.lit("-rc."), key % 13))
        .when(key % 10 == 1, F.concat(number, F.lit("-alpha")))
        .when(key % 10 == 2, F.concat(number, F.lit("+build."), key % 3))
        .when(key % 10 == 3, F.concat(F.lit("0"), number))
        .otherwise(number)
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", version.alias("version"))


def latest_version(spark, sf_dir):
    return versions.latest_version(_versions(spark, sf_dir), ["p_brand", "p_type"], "version")


def version_gate(spark, sf_dir):
    """Whether each part's version is strictly later than a fixed target, in both directions."""
    target = F.lit("6.7.5-rc.6")
    version = F.col("version")
    return _versions(spark, sf_dir).select(
        "p_partkey", versions.is_later(version, target).alias("later"), versions.is_later(target, version).alias("earlier")
    )


def versions_in_sync(spark, sf_dir):
    """Whether all parts of a brand and type have the same version."""
    return versions.all_equal(_versions(spark, sf_dir), ["p_brand", "p_type"], "version")


def version_long_numbers(spark, sf_dir):
    """Majors of 30 to 49 digits against a target of 40."""
    digits = (F.lit(30) + F.col("p_partkey") % 20).cast("int")
    version = F.concat_ws(".", F.repeat(F.lit("7"), digits), F.col("p_size").cast("string"), F.lit("0"))
    target = F.lit("7" * 40 + ".25.0")
    return table(spark, sf_dir, "part").select(
        "p_partkey", versions.is_later(version, target).alias("later"), versions.is_later(target, version).alias("earlier")
    )


QUERIES = {
    "reference_fields": reference_fields,
    "package_parts": package_parts,
    "normalise_name": normalise_name,
    "sql_functions": sql_functions,
    "substitute": substitute,
    "path_parts": path_parts,
    "short_hash": short_hash,
    "stale_text": stale_text,
    "latest_version": latest_version,
    "version_gate": version_gate,
    "versions_in_sync": versions_in_sync,
    "version_long_numbers": version_long_numbers,
}

_VERSIONS = """
n AS (SELECT *, CAST(p_size % 12 AS BIGINT) AS major, (p_partkey // 7) % 15 AS minor, p_partkey % 11 AS patch FROM part),
v AS (SELECT *, CAST(major AS VARCHAR) || '.' || CAST(minor AS VARCHAR) || '.' || CAST(patch AS VARCHAR) AS num,
  CASE p_partkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS rank,
  CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 13 ELSE 0 END AS rc FROM n),
w AS (SELECT *, p_partkey % 10 <> 3 AS ok, CASE p_partkey % 10
    WHEN 0 THEN num || '-rc.' || CAST(rc AS VARCHAR) WHEN 1 THEN num || '-alpha'
    WHEN 2 THEN num || '+build.' || CAST(p_partkey % 3 AS VARCHAR) WHEN 3 THEN '0' || num ELSE num END AS version FROM v)"""

_LATER = "(major, minor, patch, rank, rc) > (6, 7, 5, 1, 6)"
_EARLIER = "(major, minor, patch, rank, rc) < (6, 7, 5, 1, 6)"

ORACLE = {
    "reference_fields": """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'http://git/' || CAST(l_partkey AS VARCHAR) || '.git' END AS git_uri,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS sub_path,
  CASE WHEN l_orderkey % 3 <> 0 AND l_orderkey % 5 <> 0
       THEN l_linestatus || '-1.0.' || CAST(l_linenumber AS VARCHAR) END AS tag,
  CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS project_id,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'jobs/' || CAST(l_orderkey AS VARCHAR) END AS path FROM lineitem""",
    "package_parts": """
SELECT p_partkey, CASE WHEN p_size < 40 THEN replace(p_name, ' ', '_') END AS package,
  CASE WHEN p_size < 40 THEN '1.' || CAST(p_size AS VARCHAR) END AS version,
  CASE p_size % 3 WHEN 1 THEN '2.12' WHEN 2 THEN '2.13' END AS jar_version FROM part""",
    "normalise_name": r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_.]+', '_', 'g'), '__+', '_', 'g') AS name FROM documents""",
    "sql_functions": """
SELECT p_partkey, substr(sha256(p_name), 1, 8) AS hash, replace(p_name, ' ', '_') || '_' || p_type AS name,
       replace(p_brand, 'Brand#', '') AS brand, substr(p_name, 4) AS shorter, p_size % 2 = 0 AS blank,
       CASE WHEN p_partkey % 3 < 2 THEN '2.1' || CAST(2 + p_partkey % 3 AS VARCHAR) END AS jar, '1.' || CAST(p_size AS VARCHAR) AS package,
       p_brand AS bucket, p_name || '/' || p_type AS rest, p_name AS part,
       p_brand AS git_uri, CAST(p_size AS VARCHAR) AS tag, CAST(p_partkey AS VARCHAR) AS project_id FROM part""",
    "substitute": """
SELECT doc_id, text || CASE WHEN doc_id % 4 = 3 THEN ' {{PROJECT}}/{{TAG}} {{URL}} {{VERSION}}$1'
                            ELSE ' 17/Hello/1.0 http://x/{{PROJECT}} 1.0$1' END AS text FROM documents""",
    "path_parts": """
WITH p AS (SELECT page_id, url, string_split(replace(url, 'https://', ''), '/') AS parts FROM pages)
SELECT page_id, parts[1] AS bucket, array_to_string(parts[2:], '/') AS prefix,
  CASE WHEN contains(url, '.com/') THEN split_part(split_part(url, '.com/', 2), '/', 1) END AS part,
  CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS stripped,
  NOT contains(url, '#') AS no_fragment FROM p""",
    "short_hash": "SELECT doc_id, substr(sha256(text), 1, 8) AS hash FROM documents",
    "stale_text": """
SELECT doc_id,
  CASE doc_id % 8 WHEN 0 THEN 'pipelines/a/code/m.py' WHEN 1 THEN 'jobs/j/code/dag.py' WHEN 2 THEN 'pipelines/a/code/c.yml'
    WHEN 3 THEN 'pipelines/a/code/x.json' WHEN 4 THEN 'pipelines/a/code/build/m.py' WHEN 5 THEN 'jobs/j/code/job.json'
    WHEN 6 THEN 'notes.md' ELSE 'p/code/.v/workflow.latest.json' END AS path,
  CASE doc_id % 8 WHEN 0 THEN doc_id % 5 IN (0, 1) WHEN 1 THEN doc_id % 5 = 0
    WHEN 2 THEN doc_id % 5 IN (0, 1, 2) WHEN 3 THEN doc_id % 5 IN (0, 1, 2)
    WHEN 5 THEN CASE doc_id // 8 % 9 WHEN 2 THEN false WHEN 4 THEN false WHEN 7 THEN false WHEN 8 THEN doc_id % 5 IN (0, 1, 4)
      ELSE doc_id % 5 IN (0, 1) END
    WHEN 7 THEN doc_id % 5 IN (0, 1) ELSE false END AS stale FROM documents""",
    "latest_version": f"""
WITH {_VERSIONS}, b AS (SELECT * FROM w WHERE ok QUALIFY row_number() OVER (PARTITION BY p_brand, p_type
  ORDER BY major DESC, minor DESC, patch DESC, rank DESC, rc DESC, version DESC) = 1)
SELECT g.p_brand, g.p_type, b.version FROM (SELECT DISTINCT p_brand, p_type FROM part) g
LEFT JOIN b ON b.p_brand = g.p_brand AND b.p_type = g.p_type""",
    "version_gate": f"""
WITH {_VERSIONS} SELECT p_partkey, ok AND {_LATER} AS later, ok AND {_EARLIER} AS earlier FROM w""",
    "versions_in_sync": f"""
WITH {_VERSIONS}, f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1)
SELECT w.p_brand, w.p_type, bool_and(w.ok AND f.ok AND (w.major, w.minor, w.patch, w.rank, w.rc)
                                                  = (f.major, f.minor, f.patch, f.rank, f.rc)) AS in_sync
FROM w JOIN f ON w.p_brand = f.p_brand AND w.p_type = f.p_type GROUP BY 1, 2""",
    "version_long_numbers": """
SELECT p_partkey, d > 40 OR (d = 40 AND p_size > 25) AS later, d < 40 OR (d = 40 AND p_size < 25) AS earlier
FROM (SELECT *, 30 + p_partkey % 20 AS d FROM part)""",
}
