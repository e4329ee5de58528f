from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pipelinekit.operators import checks, rollups
from pipelinekit.operators.routing import route


def digest(text, salt="better_salt_than_never"):
    return hashlib.sha256(text.encode() + salt.encode()).hexdigest()


def test_fingerprint(spark, rows):
    df = spark.createDataFrame(
        [
            ("j1", "utils.py", "ü"), ("j1", "dag.py", "code"), ("j1", "README", "text"), ("j1", "a/__init__.py", ""),
            ("j2", "README", "text"), ("j3", "dag.py", None), (None, "dag.py", "n"),
        ],
        "job string, name string, body string",
    ).repartition(3)
    keep = F.col("name").rlike(r"^dag\.py$|__init__\.py|utils\.py")
    got = rollups.fingerprint(df, ["job"], "name", "body", keep=keep)
    assert rows(got) == [(None, digest("n")), ("j1", digest("$$$code$$$ü")), ("j2", digest("")), ("j3", digest(""))]
    salted = rollups.fingerprint(df.filter("job = 'j2'"), ["job"], "name", "body", salt="s", sep="-")
    assert rows(salted) == [("j2", digest("text", "s"))]


def test_fingerprint_of_a_group_over_many_batches(spark):
    """A group larger than an Arrow batch is hashed through, in order."""
    df = spark.range(25_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("name"),
        F.concat(F.lit("text "), "id").alias("body"),
    )
    got = {r["g"]: r["fingerprint"] for r in rollups.fingerprint(df, ["g"], "name", "body").collect()}
    assert got["hot"] == digest("$$$".join(f"text {i}" for i in range(0, 25_000, 3)))
    assert got["k7"] == digest("$$$".join(f"text {i}" for i in range(25_000) if i % 3 and i % 50 == 7))
    assert len(got) == 51


def test_fingerprint_keeps_key_types(spark):
    df = spark.createDataFrame([(1, "a", "n", "x"), (2, "b", "n", "y")], "k long, s string, name string, body string")
    got = rollups.fingerprint(df, ["k", "s"], "name", "body")
    assert got.dtypes == [("k", "bigint"), ("s", "string"), ("fingerprint", "string")]
    assert rollups.fingerprint(df.filter("false"), ["k"], "name", "body").collect() == []


def test_sets_and_inversion(spark, rows):
    df = spark.createDataFrame([("p", "2.13"), ("p", "2.12"), ("p", "2.13"), ("p", None), ("q", "2.12"), ("p", "2.11")], "k string, v string")
    assert rows(rollups.value_sets(df, ["k"], "v"), "k", "position", "v") == [
        ("p", 1, "2.11"), ("p", 2, "2.12"), ("p", 3, "2.13"), ("q", 1, "2.12")
    ]
    mapping = spark.createDataFrame(
        [("p1", [("c1", "f1"), ("c2", "f2")]), ("p2", [("c1", "f3")]), ("p3", []), ("p4", None), ("p0", [("c1", None), ("c1", "f1")])],
        "parent string, children array<struct<child:string,attr:string>>",
    )
    assert rows(rollups.invert(mapping, "parent", "children"), "child", "position", "parent", "attr") == [
        ("c1", 1, "p0", None), ("c1", 2, "p0", "f1"), ("c1", 3, "p1", "f1"), ("c1", 4, "p2", "f3"), ("c2", 1, "p1", "f2")
    ]


def test_severities(spark, rows):
    df = spark.createDataFrame(
        [("a", [(1, "x"), (2, "y"), (3, "z")]), ("a", [(1, "x"), None]), ("b", [(2, "w")]), ("c", []), ("d", None)],
        "k string, items array<struct<severity:int,message:string>>",
    )
    assert rows(rollups.severity_rollup(df, ["k"], "items")) == [
        ("a", 2, 1, True), ("b", 0, 1, False), ("c", 0, 0, False), ("d", 0, 0, False)
    ]
    assert rows(rollups.severity_rollup(df, ["k"], "items", warnings_as_errors=True))[1] == ("b", 0, 1, True)


def test_status_and_codes(spark, rows):
    df = spark.createDataFrame([("s1", 0), ("s1", 5), ("s2", 0), ("s2", 1), ("s3", None)], "step string, code int")
    assert rows(rollups.step_status(df, ["step"], ~rollups.succeeded(F.col("code")))) == [
        ("s1", "SUCCEEDED"), ("s2", "FAILED"), ("s3", "FAILED")
    ]
    assert rollups.step_status(df.filter("false"), ["step"], F.col("code") > 0).collect() == []


def test_last_base_path(spark, rows):
    df = spark.createDataFrame(
        [
            ("f1", "/Volumes/a/b/artifacts/x", 1), ("f1", "dbfs:/Volumes/c/artifacts/y/artifacts/z", 3), ("f1", "dbfs:/plain/artifacts/x", 4),
            ("f2", "dbfs:/plain", 1), ("f3", "/Volumes/whole", 1), (None, "/Volumes/n", 1), ("f4", None, 1),
        ],
        "f string, p string, n int",
    )
    got = rollups.last_base_path(df, "f", "p", "n", ["/Volumes", "dbfs:/Volumes"], "/artifacts/")
    assert rows(got) == [("f1", "dbfs:/Volumes/c"), ("f3", "/Volumes/whole")]


def test_route_first_rule_wins(spark, rows):
    df = spark.createDataFrame([(1, 5, True), (2, -5, True), (3, -5, False), (4, None, False), (5, 5, None)], "i int, v int, c boolean")
    rules = [("negative", F.col("v") < 0), ("unchecked", ~F.col("c"))]
    got = route(df, rules, incomplete=F.col("v").isNull())
    assert rows(got, "i", "status", "reason") == [
        (1, "valid", None), (2, "invalid", "negative"), (3, "invalid", "negative"), (4, "incomplete", "incomplete"), (5, "valid", None)
    ]
    assert rows(route(df, []), "status") == [("valid",)] * 5


def test_frame_diff_of_bags(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "w"), (4, "w")], "k int, v string")
    assert rows(checks.frame_diff(a, b, ["k", "v"])) == [(1, "x", "left", 1), (3, "z", "left", 1), (4, "w", "right", 2)]
    assert checks.frame_diff(a, a.repartition(3), ["v"]).count() == 0
    with pytest.raises(ValueError, match="keys"):
        checks.frame_diff(a, b, ["k"], tolerance=0.1)


def test_frame_diff_with_tolerance(spark, rows):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "x"), (3, None, "x"), (4, 4.0, "x"), (6, 1.0, "x"), (6, 5.0, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.4, "x"), (2, 2.6, "x"), (3, None, "y"), (5, 5.0, "x"), (6, 5.1, "x"), (6, 1.1, "x")], "k int, v double, s string")
    got = checks.frame_diff(a, b, ["k", "v", "s"], ["k"], 0.5)
    assert rows(got, "k", "side", "left_v", "right_v", "left_s", "right_s") == [
        (2, "both", 2.0, 2.6, "x", "x"), (3, "both", None, None, "x", "y"), (4, "left", 4.0, None, "x", None), (5, "right", None, 5.0, None, "x")
    ]


def test_assert_same_shows_a_few_differences(spark):
    a, b = spark.range(0, 50), spark.range(20, 70)
    checks.assert_same(a, a.repartition(2), ["id"])
    with pytest.raises(AssertionError) as failure:
        checks.assert_same(a, b, ["id"], show=3)
    assert str(failure.value).count("side") == 3


def test_predicates_and_metrics(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "i int, s string")
    found = checks.row_predicates(df, {"small": "i < 2", "named": F.col("s").isNotNull()}).first().asDict()
    assert found == {"small": 2, "named": 1}
    watched, observation = checks.observed(df, "m", ["i", "s"])
    assert watched.count() == 3
    assert observation.get == {"rows": 3, "i_nulls": 1, "s_nulls": 1}


def test_run_metrics(spark):
    """Every node is counted in the run of the sink, and computed once."""
    seen = spark.sparkContext.accumulator(0)

    def see(v, seen=seen):
        seen.add(1)
        return v

    run = checks.RunMetrics()
    source = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "i int, `odd name` string").repartition(2)
    read = run.node("read", source.withColumn("i", F.udf(see, "int")("i")))
    kept = run.node("kept", read.filter("i > 1"), ["odd name"])
    joined = run.node("joined", kept.join(spark.range(3).withColumnRenamed("id", "k"), F.col("i") == F.col("k")), [])
    run.node("total", joined.groupBy("odd name").agg(F.sum("i").alias("s"))).write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in run.table(spark).orderBy("node_index", "column").collect()] == [
        (0, "read", 4, "i", 0), (0, "read", 4, "odd name", 2), (1, "kept", 3, "odd name", 2), (2, "joined", 1, None, None),
        (3, "total", 1, "odd name", 1), (3, "total", 1, "s", 0),
    ]
    assert seen.value == 4
    with pytest.raises(ValueError, match="already"):
        run.node("read", source)


def test_many_equal_rows_in_a_keyed_comparison(spark):
    """Two hundred thousand equal rows against one less and one other: no task pairs them alone."""
    n = 200_000
    left = spark.range(n).select(F.lit("k").alias("k"), F.lit(1.0).alias("v"))
    right = spark.range(n - 1).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, 1.5).otherwise(1.0).alias("v"))
    got = checks.frame_diff(left, right, ["k", "v"], ["k"], tolerance=0.25).collect()
    assert sorted((r["side"], r["left_v"], r["right_v"]) for r in got) == [("both", 1.0, 1.5), ("left", 1.0, None)]


def test_fingerprint_of_nan_and_null_keys(spark):
    nan = float("nan")
    rows = [(nan, "a", "x"), (0.0, "a", "y"), (nan, "b", "z"), (None, "a", "x"), (-0.0, "b", "z"), (None, "b", "z")]
    df = spark.createDataFrame(rows, "k double, name string, content string").repartition(3)
    got = rollups.fingerprint(df, ["k"], "name", "content").collect()
    assert len(got) == 3 and len({r.fingerprint for r in got}) == 2


def test_fingerprint_needs_no_package_on_workers(tmp_path):
    """From another folder, and with the package on no path but the driver's own."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from pipelinekit.operators.rollups import fingerprint
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([("a", "n", "x")], "k string, name string, content string")
print("rows", fingerprint(df, ["k"], "name", "content").count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 1" in done.stdout, done.stderr[-800:]
