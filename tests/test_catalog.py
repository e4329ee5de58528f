"""Every registered query against its SQL, on the smallest sample."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from pipelinekit.catalog import ORACLE, QUERIES
from tools.compare import TABLES, bag

SF_DIR = "/root/testdata/sf0.001"
UNSCALABLE = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups"]
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="sample tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["full_name", "amount", "customer_id"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    answer = db.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNSCALABLE if node in plan]
    assert ("MapInArrow" in plan) == (name == "fingerprint")
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(columns, answer.fetchall())
