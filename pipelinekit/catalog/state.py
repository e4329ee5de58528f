"""Queries of the state tables, over snapshots derived from the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.operators import state as ops

STATE_COLUMNS = [
    "seq", "id", "name", "type", "external_job_id", "fabric_id", "is_paused", "skip_processing", "release_tag"
]


def recorded(spark, sf_dir):
    """All but the richest customers, some of them a second time in the next nation."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    base = table(spark, sf_dir, "customer").filter("c_acctbal < 9000").withColumn("seq", k * 2)
    twice = base.filter("c_mktsegment = 'FURNITURE' AND c_acctbal > 5000")
    twice = twice.withColumn("seq", F.col("seq") + 1).withColumn("c_nationkey", nation + 1)
    return base.unionByName(twice).select(
        "seq",
        F.concat(F.lit("jobs/"), k).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "B").otherwise("A").alias("type"),
        F.concat(F.lit("ext-"), k).alias("external_job_id"),
        nation.cast("string").alias("fabric_id"),
        (F.col("c_acctbal") < 0).alias("is_paused"),
        F.col("c_acctbal").between(2000, 2500).alias("skip_processing"),
        F.col("c_mktsegment").alias("release_tag"),
    )


def desired(spark, sf_dir):
    """Customers as they should be: some gone, moved, renamed, disabled or not valid."""
    k, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    gone = (F.col("c_acctbal") < -500) | ((segment == "HOUSEHOLD") & (nation >= 20))
    return table(spark, sf_dir, "customer").filter(~gone).select(
        F.concat(F.lit("jobs/"), k).alias("id"),
        F.when((segment == "AUTOMOBILE") & (nation < 10), nation + 3).otherwise(nation).alias("fabric_id"),
        F.concat(F.when(nation == 4, "new-").otherwise("ext-"), k).alias("external_job_id"),
        (F.col("c_acctbal") > 1000).alias("enabled"),
        (nation != 13).alias("valid"),
    )


# Further creations: of which segments, in which order, how many nations further on.
AGAIN = [(["MACHINERY", "FURNITURE"], 1, 1), (["FURNITURE"], 2, 0), (["FURNITURE"], 3, 1), (["FURNITURE"], 4, 0)]


def changes(spark, sf_dir):
    """A batch of changes of every kind, by nation, some failed; some keys are created up to three times."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    customer = table(spark, sf_dir, "customer")
    kind = F.when(nation < 4, "DELETED").when(nation < 8, "REFRESH").when(nation < 11, "UPDATED").otherwise("CREATED")
    rows = customer.select("*", k.alias("seq"), kind.alias("operation"), nation.alias("place"))
    for segments, step, place in AGAIN:
        rows = rows.unionByName(
            customer.filter(F.col("c_mktsegment").isin(segments)).select(
                "*", (k + step * 100_000_000).alias("seq"), F.lit("CREATED").alias("operation"), (nation + place).alias("place")
            )
        )
    return rows.select(
        "seq",
        "operation",
        (F.col("c_acctbal") > 9500).alias("failed"),
        F.concat(F.lit("jobs/"), k).alias("id"),
        F.concat(F.lit("changed "), "c_name").alias("name"),
        F.lit("A").alias("type"),
        F.concat(F.lit("ext2-"), k).alias("external_job_id"),
        F.col("place").cast("string").alias("fabric_id"),
        F.lit(False).alias("is_paused"),
        F.lit(False).alias("skip_processing"),
        F.concat(F.lit("own-"), "seq").alias("release_tag"),
    )


PLACES = [str(n) for n in range(20)]


def snapshot_diff(spark, sf_dir):
    return ops.snapshot_diff(recorded(spark, sf_dir), desired(spark, sf_dir), F.col("type") == "A", allowed=PLACES)


def snapshot_redeploy(spark, sf_dir):
    return ops.snapshot_diff(
        recorded(spark, sf_dir), desired(spark, sf_dir), F.col("type") == "A", redeploy=True, known=PLACES
    )


def apply_changes(spark, sf_dir):
    return ops.apply_changes(recorded(spark, sf_dir), changes(spark, sf_dir))


def overlay(spark, sf_dir):
    """Orders overlaid by those of a later table, whose nulls win."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    later = orders.filter("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") + 1).alias("o_orderkey"),
        F.lit("L").alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return ops.overlay(orders, later, ["o_orderkey"])


def to_process(spark, sf_dir):
    """Recorded rows that are processed at all."""
    return ops.to_process(recorded(spark, sf_dir)).select("id", "fabric_id", "type")


QUERIES = {
    "snapshot_diff": snapshot_diff,
    "snapshot_redeploy": snapshot_redeploy,
    "apply_changes": apply_changes,
    "overlay": overlay,
    "to_process": to_process,
}

_STATE = """
base AS (SELECT c_custkey * 2 AS seq, c_custkey AS k, c_nationkey AS n, c_name, c_acctbal, c_mktsegment
         FROM customer WHERE c_acctbal < 9000),
twice AS (SELECT * FROM base UNION ALL
          SELECT seq + 1, k, n + 1, c_name, c_acctbal, c_mktsegment FROM base
          WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 5000),
state AS (SELECT seq, 'jobs/' || CAST(k AS VARCHAR) AS id, c_name AS name,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'A' END AS type,
            'ext-' || CAST(k AS VARCHAR) AS external_job_id, CAST(n AS VARCHAR) AS fabric_id, c_acctbal < 0 AS is_paused,
            c_acctbal BETWEEN 2000 AND 2500 AS skip_processing, c_mktsegment AS release_tag FROM twice)"""

_DESIRED = """
desired AS (SELECT 'jobs/' || CAST(c_custkey AS VARCHAR) AS id,
              CAST(CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_nationkey < 10 THEN c_nationkey + 3
                        ELSE c_nationkey END AS VARCHAR) AS fabric_id,
              CASE WHEN c_nationkey = 4 THEN 'new-' ELSE 'ext-' END || CAST(c_custkey AS VARCHAR) AS external_job_id,
              c_acctbal > 1000 AS enabled, c_nationkey <> 13 AS valid
            FROM customer WHERE NOT (c_acctbal < -500 OR (c_mktsegment = 'HOUSEHOLD' AND c_nationkey >= 20)))"""

_ALLOWED = "CAST(fabric_id AS INTEGER) < 20"

ORACLE = {
    "snapshot_diff": f"""
WITH {_STATE}, {_DESIRED},
p AS (SELECT * FROM state WHERE NOT skip_processing), a AS (SELECT * FROM p WHERE type = 'A'),
d AS (SELECT * FROM desired WHERE {_ALLOWED}), v AS (SELECT * FROM d WHERE valid)
SELECT a.id, a.fabric_id, a.external_job_id, 'REFRESH' AS class FROM a JOIN v ON a.id = v.id AND a.fabric_id = v.fabric_id
UNION ALL SELECT a.id, a.fabric_id, a.external_job_id, 'MOVED' FROM a JOIN v ON a.id = v.id AND a.fabric_id <> v.fabric_id
UNION ALL SELECT id, fabric_id, external_job_id, 'REMOVE' FROM a WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT id, fabric_id, external_job_id, 'ADD' FROM v
          WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = v.id AND p.fabric_id = v.fabric_id)
UNION ALL SELECT id, fabric_id, external_job_id, 'SKIP' FROM desired WHERE NOT ({_ALLOWED}) OR NOT valid""",
    "snapshot_redeploy": f"""
WITH {_STATE}, {_DESIRED},
a AS (SELECT * FROM state WHERE NOT skip_processing AND type = 'A'), v AS (SELECT * FROM desired WHERE valid),
m AS (SELECT a.* FROM a JOIN v ON a.id = v.id AND a.fabric_id <> v.fabric_id)
SELECT id, fabric_id, external_job_id, 'MOVED' AS class FROM m
UNION ALL SELECT id, fabric_id, external_job_id, 'REMOVE' FROM a WHERE id NOT IN (SELECT id FROM desired) AND {_ALLOWED}
UNION ALL SELECT a.id, a.fabric_id, a.external_job_id, 'RENAME' FROM a JOIN v ON a.id = v.id AND a.fabric_id = v.fabric_id
          WHERE v.enabled AND a.external_job_id <> v.external_job_id
UNION ALL SELECT a.id, a.fabric_id, a.external_job_id, 'PAUSE' FROM a JOIN v ON a.id = v.id AND a.fabric_id = v.fabric_id
          WHERE NOT v.enabled AND NOT a.is_paused AND a.id NOT IN (SELECT id FROM m)
UNION ALL SELECT id, fabric_id, external_job_id, 'ADD' FROM v WHERE enabled
UNION ALL SELECT id, fabric_id, external_job_id, 'SKIP' FROM desired WHERE NOT valid""",
    "apply_changes": f"""
WITH RECURSIVE {_STATE},
listed AS (SELECT *, c_custkey AS seq, c_nationkey AS place,
             CASE WHEN c_nationkey < 4 THEN 'DELETED' WHEN c_nationkey < 8 THEN 'REFRESH'
                  WHEN c_nationkey < 11 THEN 'UPDATED' ELSE 'CREATED' END AS operation FROM customer
           UNION ALL SELECT c.*, c_custkey + step * 100000000, c_nationkey + further, 'CREATED'
           FROM customer c, (VALUES (1, 1), (2, 0), (3, 1), (4, 0)) a(step, further)
           WHERE c_mktsegment = 'FURNITURE' OR (c_mktsegment = 'MACHINERY' AND step = 1)),
done AS (SELECT seq, operation, 'jobs/' || CAST(c_custkey AS VARCHAR) AS id, 'changed ' || c_name AS name, 'A' AS type,
           'ext2-' || CAST(c_custkey AS VARCHAR) AS external_job_id, CAST(place AS VARCHAR) AS fabric_id,
           false AS is_paused, false AS skip_processing, 'own-' || CAST(seq AS VARCHAR) AS release_tag
         FROM listed WHERE NOT c_acctbal > 9500),
untouched AS (SELECT 0 AS kind, s.* FROM state s WHERE NOT EXISTS (SELECT 1 FROM done c
    WHERE c.operation IN ('DELETED', 'REFRESH') AND c.id = s.id AND c.fabric_id = s.fabric_id)),
cur AS (SELECT * FROM untouched UNION ALL
        SELECT 1, seq, id, name, type, external_job_id, fabric_id, is_paused, skip_processing, release_tag
        FROM done WHERE operation = 'REFRESH'),
made AS (SELECT *, lead(seq) OVER (PARTITION BY id, fabric_id ORDER BY seq) AS until FROM done WHERE operation = 'CREATED'),
starts AS (SELECT id, fabric_id, min(seq) AS until FROM made GROUP BY ALL),
lst AS (SELECT cur.*, starts.until FROM cur LEFT JOIN starts ON starts.id = cur.id AND starts.fabric_id = cur.fabric_id),
entries AS (SELECT id, kind, seq, release_tag, until FROM lst UNION ALL SELECT id, 2, seq, NULL, until FROM made),
firsts AS (SELECT m.id, m.seq, e.kind, e.seq AS of_seq, e.release_tag FROM made m JOIN entries e
           ON e.id = m.id AND (e.until IS NULL OR e.until >= m.seq) AND (e.kind < 2 OR e.seq < m.seq)
           QUALIFY row_number() OVER (PARTITION BY m.id, m.seq ORDER BY e.kind, e.seq) = 1),
tags AS (SELECT m.id, m.seq, CASE WHEN f.kind IS NULL THEN m.release_tag ELSE f.release_tag END AS tag
         FROM made m LEFT JOIN firsts f ON f.id = m.id AND f.seq = m.seq WHERE f.kind IS NULL OR f.kind < 2
         UNION ALL SELECT f.id, f.seq, t.tag FROM tags t JOIN firsts f ON f.id = t.id AND f.of_seq = t.seq AND f.kind = 2)
SELECT id, name, type, external_job_id, fabric_id, is_paused, skip_processing, release_tag FROM lst WHERE until IS NULL
UNION ALL
SELECT m.id, m.name, m.type, m.external_job_id, m.fabric_id, m.is_paused, m.skip_processing, t.tag
FROM made m JOIN tags t ON t.id = m.id AND t.seq = m.seq WHERE m.until IS NULL""",
    "overlay": """
WITH top AS (SELECT o_orderkey + 1 AS o_orderkey, 'L' AS o_orderstatus,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority
             FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM top UNION ALL
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM top)""",
    "to_process": f"WITH {_STATE} SELECT id, fabric_id, type FROM state WHERE NOT skip_processing",
}
