"""How plans hold up when one key has a third of all rows, and sides cannot be broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pipelinekit.operators import keys, lookups, rollups, running, state
from pipelinekit.plans import customers as plan

ROWS = 60_000
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def no_broadcast(spark):
    before = {name: spark.conf.get(name, None) for name in SMALL}
    for name, value in SMALL.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows have key 0."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("int")
    return spark.range(ROWS).repartition(6).select(
        k.alias("k"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("text")
    )


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(400).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), "id").alias("name"))


def final_plan(df):
    """The adaptive plan after a run."""
    df._jdf.queryExecution().executedPlan().execute().count()
    return df._jdf.queryExecution().executedPlan().toString()


def joins(hot, dim):
    orders = hot.select(F.col("v").alias("order_id"), F.col("k").alias("customer_id"), F.col("text").alias("amount"))
    customers = dim.select(
        F.col("k").alias("customer_id"), F.col("name").alias("first_name"), F.lit("x").alias("last_name"),
        F.lit("2020-01-01").alias("account_open_date"),
    )
    recorded = hot.select(
        F.col("k").cast("string").alias("id"), F.col("v").cast("string").alias("fabric_id"), F.col("text").alias("external_job_id"),
        F.lit("A").alias("type"), F.lit(False).alias("is_paused"), F.lit(False).alias("skip_processing"),
    )
    desired = dim.select(
        F.col("k").cast("string").alias("id"), F.lit("1").alias("fabric_id"), F.col("name").alias("external_job_id"),
        F.lit(False).alias("enabled"), F.lit(True).alias("valid"),
    )
    bands = dim.select(F.col("k").cast("double").alias("lo"), (F.col("k") + 1).cast("double").alias("hi"), "name")
    return {
        "inner": lambda: plan.orders_with_customers(orders, customers),
        "lookup": lambda: lookups.lookup(hot, dim, ["k"], ["name"], "first", ["name"]),
        "match": lambda: lookups.lookup_match(hot, dim, ["k"]),
        "range": lambda: lookups.range_lookup(hot, bands, "k", "lo", "hi", ["name"]),
        "semi": lambda: keys.keep_keys(hot, "k", dim),
        "anti": lambda: keys.drop_keys(hot, dim, ["k"]),
        "moved": lambda: keys.moved_rows(hot, dim.withColumnRenamed("name", "text"), "k", "text"),
        "diff": lambda: state.snapshot_diff(recorded, desired, F.col("type") == "A", redeploy=True),
    }


NAMES = ["inner", "lookup", "match", "range", "semi", "anti", "moved", "diff"]


@pytest.mark.parametrize("name", NAMES)
def test_a_frequent_key_is_split(no_broadcast, hot, dim, name):
    """Nothing behind the join needs its partitioning, so Spark may split the hot partition."""
    assert "skew=true" in final_plan(joins(hot, dim)[name]()).lower()


def test_totals_shuffle_sums_not_orders(no_broadcast, hot, dim):
    orders = hot.select(F.col("v").alias("order_id"), F.col("k").alias("customer_id"), F.col("v").alias("amount"))
    customers = dim.select(F.col("k").alias("customer_id"), F.lit("2020-01-01").alias("account_open_date"))
    whole = plan.customer_orders(orders, customers)
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2  # one per table; the join reuses both
    assert text.index("partial_sum") > text.index("Exchange")
    assert whole.filter("customer_id = 0").first()["orders"] == hot.filter("k = 0").count()


def parts_of_key(df, key):
    """Range partitions that hold rows of a key in the table that numbering wrote."""
    files = [f for f in df.inputFiles() if "/ordered-" in f]
    written = df.sparkSession.read.parquet(*files)
    return written.filter(F.col(key) == 0).select(F.shiftright("__at", 33)).distinct().count()


def test_positions_of_a_frequent_key_are_spread(no_broadcast, hot, dim):
    """No task orders a frequent key alone, for n-th rows, all rows and sets alike."""
    nth = lookups.lookup(dim, hot, ["k"], ["text"], "nth", ["v"], n=5)
    assert parts_of_key(nth, "k") > 2
    assert nth.filter("k = 0").first()["text"] == hot.filter("k = 0").orderBy("v").limit(5).collect()[-1]["text"]
    every = lookups.lookup_rows(dim, hot, ["k"], ["v"], ["v"])
    assert parts_of_key(every, "__key_k") > 2
    sets = rollups.value_sets(hot, ["k"], "text")
    assert parts_of_key(sets, "k") > 2
    top = sets.filter("k = 0").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("most")).first()
    assert top["n"] == top["most"] == hot.filter("k = 0").select("text").distinct().count()


def test_one_wide_range_among_many_narrow_ones(spark):
    """The wide range has a level of its own: the narrow ones stay in bins as narrow as they are."""
    narrow = spark.range(20_000).selectExpr("CAST(id AS double) AS lo", "CAST(id + 1 AS double) AS hi", "CAST(id AS string) AS name")
    bands = narrow.unionByName(spark.createDataFrame([(0.0, 1e9, "wide")], narrow.schema))
    asked = spark.range(20_000).selectExpr("id + 0.5D AS x")
    got = lookups.range_lookup(asked, bands, "x", "lo", "hi", ["name"])
    assert got.count() == 40_000
    assert got.filter("name = 'wide'").count() == 20_000


def test_a_frequent_value_is_divided(no_broadcast, hot):
    """A third of the rows have one value, in one part of the line: they are ranked in several window partitions, and the join is one that Spark can split."""
    bands = no_broadcast.range(40).selectExpr("CAST(id * 10 AS int) AS lo", "CAST(id * 10 + 9 AS int) AS hi", "id AS name")
    got = lookups.range_lookup(hot, bands, "k", "lo", "hi", ["name"])
    assert got.count() == ROWS and got.filter("k = 0 AND name = 0").count() == hot.filter("k = 0").count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__division" in plan
    divided = hot.select(F.pmod(F.xxhash64(*hot.columns), F.lit(4)).alias("d"), "k").filter("k = 0").groupBy("d").count()
    assert divided.count() == 4


def scans(df):
    """How often the plan reads files, reused exchanges not counted again."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan" in line for line in plan.splitlines())


@pytest.fixture
def files(spark, tmp_path):
    """A folder of tables as files, written from frames."""

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return written


def test_orders_are_read_once(files, hot, dim):
    orders = files(hot.selectExpr("v AS order_id", "k AS customer_id", "v AS amount", "'2000-01-01' AS order_date"), "orders")
    customers = files(dim.selectExpr("k AS customer_id"), "customers")
    summary = plan.customer_orders_from_first(orders, customers, F.lit("2000-01-11").cast("date"))
    assert scans(summary) == 2
    busy = summary.filter("customer_id = 0").first()
    assert busy["orders"] == hot.filter("k = 0").count() and busy["account_length_days"] == 10


def test_changes_read_state_and_changes_once(spark, files, monkeypatch):
    """All that is written while the plan is built together reads each input once."""
    names = "id, name, type, external_job_id, fabric_id, is_paused, skip_processing, release_tag"
    row = ["CAST(id % 50 AS string) AS id", "'n' AS name", "'A' AS type", "'x' AS external_job_id", "CAST(id % 7 AS string) AS fabric_id",
           "false AS is_paused", "false AS skip_processing", "CAST(id AS string) AS release_tag"]
    recorded = files(spark.range(500).selectExpr("id AS seq", *row), "state")
    kinds = "element_at(array('CREATED', 'DELETED', 'REFRESH'), CAST(id % 3 + 1 AS int)) AS operation"
    changes = files(spark.range(300).selectExpr("id AS seq", kinds, "false AS failed", *row), "changes")
    plans, write = [], state.stored
    for module in (state, running):
        monkeypatch.setattr(module, "stored", lambda df, name: plans.append(df.inputFiles()) or write(df, name))
    after = state.apply_changes(recorded, changes)
    assert ", ".join(after.columns) == names
    read = [set(recorded.inputFiles()), set(changes.inputFiles())]
    assert [sum(bool(files & set(found)) for found in [*plans, after.inputFiles()]) for files in read] == [1, 1]
