"""The registered queries against their SQL, on the smallest sample."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from pipelinekit.llm.queries import ORACLE, QUERIES
from tools.compare import bag

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="sample tables not present")


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    db = duckdb.connect()
    for source in ("documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {source} AS SELECT * FROM '{SF_DIR}/{source}.parquet'")
    answer = db.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    df = QUERIES[name](spark, SF_DIR)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(columns, answer.fetchall())


def test_shards_use_no_python(spark):
    plan = QUERIES["op2_sharding"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
