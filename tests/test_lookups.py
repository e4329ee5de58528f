from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pipelinekit.operators import keys as joins
from pipelinekit.operators import lookups as ops
from pipelinekit.operators.prepared import prepare_lookup


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(
        [(1, 10, "a"), (1, 30, "c"), (1, 20, "b"), (2, 5, None), (2, 6, "z"), (None, 1, "n"), (9, 1, "x")],
        "id int, t int, v string",
    )


@pytest.mark.parametrize(
    ("which", "n", "one", "two"),
    [("first", None, "a", None), ("last", None, "c", "z"), ("nth", 2, "b", "z"), ("nth", 3, "c", None), ("nth", 4, None, None)],
)
def test_lookup(asked, ref, rows, which, n, one, two):
    got = ops.lookup(asked, ref, {"k": "id"}, ["v"], which, ["t"], n)
    assert got.columns == ["k", "v"]
    assert rows(got) == sorted(
        [(None, None), (1, one), (1, one), (2, two), (3, None)], key=lambda r: [(v is not None, v) for v in r]
    )


def test_nth_far_behind(spark, rows):
    ref = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    asked = spark.createDataFrame([(0,), (1,), (2,)], "k long")
    got = ops.lookup(asked, ref, ["k"], ["t"], "nth", ["t"], n=1200)
    assert rows(got) == [(0, 2398), (1, 2399), (2, None)]


def test_lookup_needs_an_order(asked, ref):
    with pytest.raises(ValueError, match="order_by"):
        ops.lookup(asked, ref, {"k": "id"}, ["v"])
    with pytest.raises(ValueError, match="nth"):
        ops.lookup(asked, ref, {"k": "id"}, ["v"], "nth", ["t"])


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(name, None) for name in names]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_prepared(asked, ref, rows):
    """The same as the lookups that prepare nothing."""
    prepared = prepare_lookup(ref, {"k": "id"}, ["v", "t"], ["t"])
    on = {"k": "id"}
    try:
        for which in ("first", "last"):
            assert rows(getattr(prepared, which)(asked, on)) == rows(ops.lookup(asked, ref, on, ["v", "t"], which, ["t"]))
        assert rows(prepared.match(asked, on)) == rows(ops.lookup_match(asked, ref, on))
        assert rows(prepared.count(asked, on)) == rows(ops.lookup_count(asked, ref, on))
        one = (1, "a", 10, "c", 30, True, 3)
        nothing = (None, None, None, None, False, 0)
        assert rows(prepared.every(asked, on)) == [(None, *nothing), one, one, (2, None, 5, "z", 6, True, 2), (3, *nothing)]
        with pytest.raises(ValueError, match="prepared for keys id"):
            prepared.first(asked, {"k": "t"})
    finally:
        prepared.close()
    with pytest.raises(ValueError, match="order_by"):
        prepare_lookup(ref, ["id"], ["v"], [])


def test_prepared_by_two_columns_of_any_kind(spark, rows):
    ref = spark.createDataFrame([(1, "x", {"a": 1}), (1, None, {"b": 1}), (1, "x", {"c": 1}), (2, "y", None)], "a int, b string, m map<string,int>")
    ref = ref.withColumn("t", F.monotonically_increasing_id())
    asked = spark.createDataFrame([("x", 1), (None, 1), ("y", 2), ("z", 2)], "q string, p int")
    prepared = prepare_lookup(ref, ["a", "b"], ["m"], ["t"], buckets=3)
    got = {r["q"]: (r["m"], r["n"]) for r in prepared.count(prepared.last(asked, {"p": "a", "q": "b"}), {"q": "b", "p": "a"}, "n").collect()}
    assert got == {"x": ({"c": 1}, 2), None: (None, 0), "y": (None, 1), "z": (None, 0)}
    assert prepared.first(asked.filter("false"), {"p": "a", "q": "b"}).collect() == []
    empty = prepare_lookup(ref.filter("false"), ["a"], ["b"], ["t"])
    assert rows(empty.count(asked.select(F.col("p").alias("a")).distinct())) == [(1, 0), (2, 0)]


def test_a_prepared_reference_is_read_and_shuffled_once(spark, asked, no_broadcast):
    seen = spark.sparkContext.accumulator(0)

    def see(v, seen=seen):
        seen.add(1)
        return v

    ref = spark.range(100).select((F.col("id") % 7).cast("int").alias("id"), F.udf(see, "long")("id").alias("t"))
    prepared = prepare_lookup(ref, ["id"], ["t"], ["t"])
    on = {"k": "id"}
    for found in (prepared.first(asked, on), prepared.match(asked, on), prepared.count(asked, on)):
        assert found.count() == 5
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        # What is read lies in its buckets; the exchanges are those of the asked keys, of what they found, and of the asking rows.
        assert "Bucketed: true" in plan and prepared.table in plan
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") <= 3
        line = next(i for i, text in enumerate(final.splitlines()) if prepared.table in text)
        above = final.splitlines()[max(0, line - 4) : line]
        assert not any("Exchange" in text for text in above)
    assert seen.value == 100


def test_match_and_count(asked, ref, rows):
    assert rows(ops.lookup_match(asked, ref, {"k": "id"})) == [(None, False), (1, True), (1, True), (2, True), (3, False)]
    assert rows(ops.lookup_count(asked, ref, {"k": "id"})) == [(None, 0), (1, 3), (1, 3), (2, 2), (3, 0)]


def test_two_key_columns(spark, rows):
    asked = spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "a int, b string")
    ref = spark.createDataFrame([(1, "x", 7), (1, None, 8), (2, "y", 9)], "a int, b string, v int")
    assert rows(ops.lookup(asked, ref, ["a", "b"], ["v"], "first", ["v"])) == [(1, None, None), (1, "x", 7), (1, "y", None)]


@pytest.mark.parametrize("reverse", [False, True])
def test_rows(asked, ref, reverse):
    got = ops.lookup_rows(asked, ref, {"k": "id"}, ["v", "t"], ["t"], reverse)
    assert got.columns == ["k", "position", "v", "t"]
    one, two = [("a", 10), ("b", 20), ("c", 30)], [(None, 5), ("z", 6)]
    want = {(k, n, *row) for k, found in ((1, one), (2, two)) for n, row in enumerate(found[::-1] if reverse else found, 1)}
    assert sorted(map(str, got.collect())) == sorted(str(Row(*got.columns)(*r)) for r in want | {(3, None, None, None), (None, None, None, None)})


def test_map_columns_can_be_looked_up(spark):
    asked = spark.createDataFrame([(1,), (2,)], "k int")
    ref = spark.createDataFrame([(1, 2, {"a": 1}, "y"), (1, 1, {"b": 2}, "x"), (1, 1, {"b": 2}, "w")], "k int, t int, m map<string,int>, v string")
    found = lambda *a, **b: [tuple(r) for r in ops.lookup(asked, ref, ["k"], ["m", "v"], *a, order_by=["t"], **b).orderBy("k").collect()]
    assert found("first") == [(1, {"b": 2}, "w"), (2, None, None)]
    assert found("last") == [(1, {"a": 1}, "y"), (2, None, None)]
    assert found("nth", n=3) == [(1, {"a": 1}, "y"), (2, None, None)]
    listed = ops.lookup_rows(asked, ref, ["k"], ["m"], ["t", "v"]).orderBy("k", "position").collect()
    assert [tuple(r) for r in listed] == [(1, 1, {"b": 2}), (1, 2, {"b": 2}), (1, 3, {"a": 1}), (2, None, None)]


def test_range_is_half_open(spark, rows):
    asked = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (25.0,), (30.0,), (None,)], "x double")
    bands = spark.createDataFrame([(0.0, 10.0, "low"), (10.0, 30.0, "high"), (5.0, 5.0, "empty")], "lo double, hi double, name string")
    got = ops.range_lookup(asked, bands, "x", "lo", "hi", ["name"])
    assert rows(got) == [
        (None, None), (-1.0, None), (0.0, "low"), (9.99, "low"), (10.0, "high"), (25.0, "high"), (30.0, None)
    ]


def test_overlapping_ranges_and_bounds(spark, rows):
    asked = spark.createDataFrame([(7,), (50,)], "x int")
    bands = spark.createDataFrame([(0, 10, "a"), (5, 1000, "b")], "lo int, hi int, name string")
    assert rows(ops.range_lookup(asked, bands, "x", "lo", "hi", ["name"])) == [(7, "a"), (7, "b"), (50, "b")]
    assert rows(ops.range_lookup(asked, bands.filter("lo < 0"), "x", "lo", "hi", ["name"])) == [(7, None), (50, None)]


def test_ranges_of_all_widths_and_open_ends(spark):
    inf = float("inf")
    bands = [(i * 0.5, i * 0.5 + 10.0 ** (i % 10 - 3), f"r{i}") for i in range(60)]
    bands += [(-inf, 3.0, "below"), (20.0, inf, "above"), (-inf, inf, "all"), (None, 4.0, "none"), (5.0, 1e308, "far"), (-1e308, 1e308, "wide"), (8.0, 8.0 + 2**-40, "thin")]
    values = [-inf, -1e300, -1.0, 0.0, 0.25, 2.9999, 3.0, 8.0, 8.5, 19.99, 1e6, 1e307, inf, float("nan")]
    asked = spark.createDataFrame([(v,) for v in values] + [(8.0,), (None,)], "x double")
    got = ops.range_lookup(asked, spark.createDataFrame(bands, "lo double, hi double, name string"), "x", "lo", "hi", ["name"]).collect()
    want = []
    for v in [*values, 8.0, None]:
        hits = [n for lo, hi, n in bands if v is not None and lo is not None and lo <= v < hi]
        want += [(repr(v), n) for n in hits or [None]]
    assert sorted(map(str, want)) == sorted(str((repr(r.x), r.name)) for r in got)


def test_nested_ranges(spark):
    """Twenty thousand ranges around each other, some with equal ends: a value is compared only with those it lies in."""
    n = 20_000
    bands = spark.range(n).select(F.col("id").alias("lo"), (2 * n - F.expr("id - id % 3")).alias("hi"), F.col("id").alias("r"))
    values = [-1, 0, 1, 77, n // 2, n - 1, n, n + 1, 2 * n - 78, 2 * n - 1, 2 * n]
    got = ops.range_lookup(spark.createDataFrame([(v,) for v in values] * 2, "x long"), bands, "x", "lo", "hi", ["r"])
    found = {r["x"]: r["n"] for r in got.groupBy("x").agg(F.count("r").alias("n")).collect()}
    assert found == {v: 2 * sum(i <= v < 2 * n - (i - i % 3) for i in range(n)) for v in values}
    assert got.filter("r IS NOT NULL AND NOT (r <= x AND x < 40000 - (r - r % 3))").isEmpty()


@pytest.mark.parametrize("parts", ["1", "7"])
def test_random_ranges(spark, parts):
    """Values of few kinds, ranges of all widths, decimals against integers."""
    rng = random.Random(11)
    bands = [(lo := rng.randrange(-50, 50), lo + rng.choice([0, 1, 2, 5, 30, 200]), i) for i in range(120)]
    values = [rng.choice([None, 0.0, -0.0, rng.uniform(-60, 60)]) for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        asked = spark.createDataFrame(list(enumerate(values)), "i int, x double")
        got = {tuple(r) for r in ops.range_lookup(asked, spark.createDataFrame(bands, "lo int, hi int, r int"), "x", "lo", "hi", ["r"]).select("i", "r").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hits = {i: [r for lo, hi, r in bands if v is not None and lo <= v < hi] for i, v in enumerate(values)}
    assert got == {(i, r) for i, found in hits.items() for r in found or [None]}


def test_ranges_are_one_plan(spark):
    """Building the lookup runs nothing: its input is not touched before the result is."""
    seen = spark.sparkContext.accumulator(0)

    def see(v, seen=seen):
        seen.add(1)
        return v

    asked = spark.range(10).select(F.udf(see, "double")(F.col("id").cast("double")).alias("x"))
    got = ops.range_lookup(asked, spark.createDataFrame([(0.0, 5.0)], "lo double, hi double"), "x", "lo", "hi", ["lo"])
    assert seen.value == 0 and got.filter("lo IS NOT NULL").count() == 5
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_keep_drop_and_union(spark, rows):
    df = spark.createDataFrame([("j/1", 1), ("j/2", 2), ("3", 3), (None, 4)], "id string, v int")
    assert rows(joins.keep_keys(df, "id", "1,2", "j/"), "v") == [(1,), (2,)]
    assert joins.keep_keys(df, "id", None) is df
    assert joins.keep_keys(df, "id", "") is df
    listed = joins.listed_keys(spark.createDataFrame([("1,3",), ("1",), (None,)], "t string"), "t", "j/")
    assert rows(listed) == [("j/1",), ("j/3",)]
    assert rows(joins.keep_keys(df, "id", listed), "v") == [(1,)]
    other = spark.createDataFrame([("j/1",), ("j/1",), (None,)], "id string")
    assert rows(joins.drop_keys(df, other, ["id"]), "v") == [(2,), (3,), (4,)]
    assert rows(joins.minus(df, other, ["id"]), "v") == [(2,), (3,)]
    assert rows(joins.all_keys(df, other, ["id"])) == [(None,), ("3",), ("j/1",), ("j/2",)]


def test_moved(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", None), ("e", "1")], "id string, place string")
    other = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("d", "1"), ("e", None)], "id string, place string")
    assert rows(joins.moved_rows(df, other, "id", "place")) == [("a", "2"), ("b", "1"), ("d", None), ("e", "1")]


def test_pairs(spark, rows):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    got = joins.pairs_with(df, "b", ["x", "y"])
    assert rows(got) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_id_or_name(spark, rows):
    ref = spark.createDataFrame([("p/1", "one", 1), ("p/2", "two", 2), ("p/3", "two", 3), ("p/4", "", 4)], "id string, name string, n int")
    df = spark.createDataFrame(
        [("a", "1", "two"), ("b", "p/3", None), ("c", "9", "two"), ("d", None, "one"), ("e", "", "none"), ("f", None, "")],
        "row string, i string, n string",
    )
    got = joins.match_id_or_name(df, ref, "i", "n", "id", "name", ["n"], "p/")
    assert rows(got, "row", "match_id", "match_name") == [
        ("a", "p/1", "one"), ("b", "p/3", "two"), ("c", "p/2", "two"), ("d", "p/1", "one"), ("e", None, None), ("f", None, None)
    ]


def test_with_component(spark, rows):
    df = spark.createDataFrame([(1, "x", True), (2, "y", True), (3, "x", False), (4, "x", True), (5, "x", None)], "id int, place string, on boolean")
    managed = spark.createDataFrame([("x",)], "p string")
    holders = spark.createDataFrame([(1,), (1,), (2,), (3,), (5,)], "id int")
    assert rows(joins.with_component(df, F.col("on"), "place", managed, "id", holders), "id") == [(1,)]
