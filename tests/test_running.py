from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pipelinekit.operators.running import in_lists, numbered, running


@pytest.fixture(scope="module")
def data(spark):
    """One group holds most of the rows; another key is null."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(20)]), i, rng.randint(-50, 50)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "g string, t int, i int, v int").repartition(5)


def expected(rows, merge):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    out = set()
    for members in groups.values():
        total = None
        for g, t, i, v in sorted(members, key=lambda r: (r[1] is not None, r[1] or 0, -r[2])):
            total = v if total is None else merge(total, v)
            out.add((g, t, i, total))
    return out


@pytest.mark.parametrize(("how", "merge"), [("sum", lambda a, b: a + b), ("min", min)])
def test_running(data, how, merge):
    rows, df = data
    got = running(df, ["g"], ["t", F.col("i").desc()], F.col("v"), how, "r")
    assert {(r["g"], r["t"], r["i"], r["r"]) for r in got.collect()} == expected(rows, merge)
    assert got.columns == ["g", "t", "i", "v", "r"]


@pytest.mark.parametrize(("how", "merge"), [("sum", lambda a, b: a + b), ("min", min)])
def test_running_before_a_row(data, how, merge):
    rows, df = data
    got = running(df, ["g"], ["t", F.col("i").desc()], F.col("v"), how, "r", before=True)
    after = {(g, t, i): r for g, t, i, r in expected(rows, merge)}
    for g in {row[0] for row in rows}:
        found = sorted((r for r in got.collect() if r["g"] == g), key=lambda r: (r["t"] is not None, r["t"] or 0, -r["i"]))
        assert [r["r"] for r in found] == [None, *[after[(g, r["t"], r["i"])] for r in found[:-1]]]


@pytest.fixture
def small_partitions(spark):
    """Partitions stay apart, however small they are."""
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_large_group_is_spread(spark, data, small_partitions):
    """No task orders the large group alone: its rows lie in several range partitions."""
    rows, df = data
    got = numbered(df, ["g"], ["t", "i"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan and "CartesianProduct" not in plan
    files = spark.read.parquet(*[f for f in got.inputFiles() if "/ordered-" in f])
    assert files.filter("g = 'hot'").select(F.shiftright("__at", 33)).distinct().count() > 1
    hot = got.filter("g = 'hot'").agg(F.count(F.lit(1)), F.max("position"), F.countDistinct("position")).first()
    assert hot[0] == hot[1] == hot[2] == sum(r[0] == "hot" for r in rows)


def test_equal_rows_are_spread(spark, small_partitions):
    """Rows that nothing tells apart have every position once, and no task orders them alone."""
    got = numbered(spark.range(20_000).select(F.lit("a").alias("g"), F.lit(1).alias("t")).repartition(5), ["g"], ["t"])
    files = spark.read.parquet(*[f for f in got.inputFiles() if "/ordered-" in f])
    assert files.groupBy(F.shiftright("__at", 33)).count().agg(F.max("count")).first()[0] < 10_000
    assert got.agg(F.count(F.lit(1)), F.max("position"), F.countDistinct("position")).first()[:] == (20_000,) * 3


def test_rows_are_evaluated_once(spark, data):
    """Both with a large group and without one."""
    rows, df = data
    for kept in (df, df.withColumn("g", F.col("i").cast("string"))):
        seen = spark.sparkContext.accumulator(0)

        def see(v, seen=seen):
            seen.add(1)
            return v

        got = numbered(kept.withColumn("v", F.udf(see, "int")("v")), ["g"], ["t", "i"])
        assert got.count() == len(rows) and got.filter("position > 0 AND v IS NOT NULL").count() == len(rows)
        assert seen.value == len(rows)


def test_without_groups(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "t int, i int").repartition(3)
    got = sorted((r["position"], r["t"], r["i"]) for r in numbered(df, [], ["t", "i"]).collect())
    assert got == [(n, *row) for n, row in enumerate(sorted((i % 7, i) for i in range(50)), 1)]


def test_zeros_of_both_signs_are_one_group(spark):
    df = spark.createDataFrame([(0.0, i) if i % 2 else (-0.0, i) for i in range(40)], "g double, t int")
    assert sorted(r["position"] for r in numbered(df, ["g"], ["t"]).collect()) == list(range(1, 41))


def test_nothing_to_number(data):
    _, df = data
    assert numbered(df.filter("false"), ["g"], ["t", "i"]).collect() == []


def test_lists_continue_in_chunks(data):
    rows, df = data
    got = in_lists(numbered(df, ["g"], ["i"]), ["g"], F.col("i"), 50).collect()
    assert max(len(r["items"]) for r in got) <= 50
    for key in ("hot", "a", "b", None):
        chunks = [r["items"] for r in sorted((r for r in got if r["g"] == key), key=lambda r: r["chunk"])]
        assert [i for chunk in chunks for i in chunk] == sorted(r[2] for r in rows if r[0] == key)


def test_a_row_without_a_position_is_no_item(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", None, None)], "g string, position long, v string")
    assert {(r["g"], r["chunk"], str(r["items"])) for r in in_lists(df, ["g"], F.col("v"), 2).collect()} == {
        ("a", 0, "['x']"), ("b", 0, "None")
    }
