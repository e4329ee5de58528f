from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pipelinekit.functions import nested, registry, text, versions

REFERENCE = "gitUri=https://git.example.org/a/b.git&subPath=&tag=Night/load-3.1&projectSubscriptionProjectId=12&path=pipelines/night"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, fn):
    return [r[0] for r in column(spark, values).orderBy("i").select(fn(F.col("v"))).collect()]


def test_reference_fields(spark):
    got = apply(spark, [REFERENCE, "pipelines/x", REFERENCE.replace("Night/", ""), None], text.reference_fields)
    assert tuple(got[0]) == ("https://git.example.org/a/b.git", "", "load-3.1", "12", "pipelines/night")
    assert set(got[1]) == {None} and set(got[3]) == {None}
    assert got[2]["tag"] is None and got[2]["project_id"] == "12"


def test_packages_and_jars(spark):
    paths = [
        "dbfs:/x/pipeline/customers_orders-1.0-py3-none-any.whl", "dbfs:/x/pipeline/a-b-2.10.3-py3-none-any.whl",
        "dbfs:/x/other.whl", None,
    ]
    assert [tuple(r) for r in apply(spark, paths, text.package_parts)] == [
        ("customers_orders", "1.0"), ("a-b", "2.10.3"), (None, None), (None, None)
    ]
    assert apply(spark, ["l_2.12.jar", "l_2.13.jar", "l_2.11.jar", "l_2.12.jar.bak", None], text.jar_version) == [
        "2.12", "2.13", None, None, None
    ]


def test_normalise_name(spark):
    names = ["a b--c", "a__b___c", "x.y", "ä ö", "日本-語", "__", "²x"]
    assert apply(spark, names, text.normalise_name) == ["a_b_c", "a_b_c", "x.y", "ä_ö", "日本_語", "_", "²x"]


def test_substitute(spark):
    df = spark.createDataFrame([("a.json",), ("a.md",), ("a.py.txt",), ("b.py",)], "n string")
    body = F.lit("{X}.{X} $1 {Y}")
    got = df.select("n", text.substitute(F.col("n"), body, {"{X}": "1{Y}", "{Y}": r"\2$"})).collect()
    done = r"1\2$.1\2$ $1 \2$"
    assert dict(map(tuple, got)) == {"a.json": done, "b.py": done, "a.md": "{X}.{X} $1 {Y}", "a.py.txt": "{X}.{X} $1 {Y}"}


def test_small_helpers(spark):
    assert apply(spark, ["pre/x", "x/pre/", "pre/pre/", None], lambda c: text.strip_prefix(c, "pre/")) == ["x", "x/pre/", "pre/", None]
    blanks = [None, "", "  ", "\t\n ", " ", "\x1f", "a", " a "]
    assert apply(spark, blanks, text.is_blank) == [not (isinstance(b, str) and b and bool(b.strip())) for b in blanks]
    paths = ["s3://b/p/q/", "s3://b", "b//x", None]
    assert apply(spark, paths, lambda c: text.bucket_of(c, "s3://")) == ["b", "b", "b", None]
    assert apply(spark, paths, lambda c: text.prefix_of(c, "s3://")) == ["p/q/", "", "/x", None]
    deep = ["dbfs:/v/artifacts/dev/cp/1", "plain", "x/artifacts/dev"]
    assert apply(spark, deep, lambda c: text.part_behind(c, "/artifacts/", 2)) == ["cp", None, ""]
    assert apply(spark, ["main"], text.short_hash) == [hashlib.sha256(b"main").hexdigest()[:8]]


def test_same_on(spark):
    df = spark.createDataFrame([(1, None, 1, None), (1, None, 1, 2), (1, 2, 3, 2)], "a int, b int, c int, d int")
    same = text.same_on({"x": F.col("a"), "y": F.col("b")}, {"x": F.col("c"), "y": F.col("d")})
    assert [r[0] for r in df.select(same).collect()] == [True, False, False]


def test_is_stale(spark):
    old, new = "pipelines/old", "pipelines/new"
    cases = [
        ("p/code/a.py", f'x = "{old}"', True),
        ("p/code/a.py", f"# {old} here", True),
        ("p/code/a.py", f"# {old}er here", False),
        ("p/code/a.py", f'"{old}" and {new}', False),
        ("jobs/j/a.py", f"# {old} here", False),
        ("jobs/j/a.py", f"'{old}'", True),
        ("p/code/a.yml", f"k: {old}er", True),
        ("jobs/j/a.yml", f"k: {old}", False),
        ("p/code/build/a.py", f'"{old}"', False),
        ("p/code/rebuild.py", f'"{old}"', True),
        ("p/code/a.txt", old, False),
        ("p/code/other.json", f'{{"a": "{old}"}}', True),
        ("p/code/workflow.latest.json", f'{{"metainfo": {{"uri": "{old}"}}, "x": "{new}"}}', True),
        ("p/code/workflow.latest.json", f'{{"metainfo": {{"uri": "other"}}, "x": "{old}"}}', False),
        ("p/code/workflow.latest.json", f'{{"metainfo": {{}}, "x": "{old}"}}', False),
        ("p/code/workflow.latest.json", f"broken {old}", True),
        ("jobs/j/job.json", f'{{"processes": {{"p": {{"properties": {{"pipelineId": "{old}"}}}}}}}}', True),
        ("jobs/j/job.json", f'{{"processes": {{"p": {{"properties": {{"pipelineId": {{"type": "literal", "value": "{old}"}}}}}}}}}}', True),
        ("jobs/j/job.json", f'{{"processes": {{}}, "note": "{old}"}}', False),
        ("jobs/j/job.json", f'{{"components": [{{"PipelineComponent": {{"pipelineId": "{old}"}}}}]}}', True),
        ("jobs/j/job.json", None, False),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, p string, t string")
    stale = text.is_stale(F.col("p"), F.col("t"), old, new, nested.document_references(F.col("p"), F.col("t")))
    got = [r[0] for r in df.orderBy("i").select(stale).collect()]
    assert [(c[0], c[1], g) for c, g in zip(cases, got, strict=True)] == [tuple(c) for c in cases]


ORDERED = [
    "0.0.1-rc.1", "0.0.1", "0.0.2", "0.1.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta",
    "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.9.0", "1.10.0", "999999.0.0", "99999999999999999999.0.0",
]
BROKEN = ["1.0", "01.0.0", "1.0.0-01", "1.0.0-", "1.0.0-a..b", "invalid-0.0.0-thing", "", None]


def test_version_order(spark):
    got = apply(spark, ORDERED[::-1] + BROKEN, versions.version_key)
    assert all(k is None for k in got[len(ORDERED):])
    df = column(spark, ORDERED[::-1]).orderBy(versions.version_key(F.col("v")))
    assert [r["v"] for r in df.collect()] == ORDERED


def test_version_gates(spark, rows):
    df = spark.createDataFrame(
        [("0.0.1", "0.0.1"), ("0.0.2", "0.0.1"), ("0.0.1+build.1", "0.0.1"), ("x", "0.0.1"), ("1.0.0", "x"), ("0.0.1", "0.0.1-rc.1")],
        "a string, b string",
    )
    got = [r[0] for r in df.select(versions.is_later(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, False, False, False, True]
    same = spark.createDataFrame([("g", "1.0.0", "1.0.0+x"), ("h", "1.0.0", "1.0.0"), ("h", "1.0.1", "1.0.0"), ("i", "bad", "bad")], "g string, v string, e string")
    assert rows(versions.in_sync(same, ["g"], "v", "e")) == [("g", True), ("h", False), ("i", False)]
    latest = spark.createDataFrame([("g", "1.9.0"), ("g", "1.10.0"), ("g", "2.0"), ("h", "bad")], "g string, v string")
    assert rows(versions.latest_version(latest, ["g"], "v")) == [("g", "1.10.0"), ("h", None)]


def test_registered_functions_agree(spark):
    """Every function from SQL text, on awkward values, as applied to columns."""
    names = registry.register_functions(spark)
    assert names == [function.__name__ for function in registry.FUNCTIONS] and len(names) == 10
    values = [
        "a b--c", "Brand#1", None, "", "日本 語", " \u00a0\t", "x/pipeline/night_load-7.2-py3-none-any.whl", "lib_2.13.jar", "s3://b/p/q\\r/s's",
        "gitUri=g&subPath=s&tag=a/b/c&projectSubscriptionProjectId=5&path=p", "line\nbreak/x",
    ]
    column(spark, values).createOrReplaceTempView("names")
    others = {"prefix": F.lit("Brand#"), "scheme": F.lit("s3://"), "marker": F.lit("b/"), "n": F.lit(1)}
    for function, arguments in registry.FUNCTIONS.items():
        rest = list(arguments)[1:]
        texts = ", ".join(["v", *[{"prefix": "'Brand#'", "scheme": "'s3://'", "marker": "'b/'", "n": "1"}[a] for a in rest]])
        got = spark.sql(f"SELECT {function.__name__}({texts}) AS r FROM names ORDER BY i")
        want = spark.table("names").orderBy("i").select(function(F.col("v"), *[others[a] for a in rest]).alias("r"))
        assert [r[0] for r in got.collect()] == [r[0] for r in want.collect()], function.__name__
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("suffixes", [(".json",), (".a+b", ".py")])
def test_ends_with_any_is_literal(spark, suffixes):
    values = ["x.json", "xjson", "x.a+b", "x.aab", "x.py"]
    assert apply(spark, values, lambda c: text.ends_with_any(c, suffixes)) == [v.endswith(suffixes) for v in values]


def test_typed_lit(spark):
    from pipelinekit.functions.literals import typed_lit

    got = spark.range(1).select(typed_lit({"a": [1, 2], "b": []}), typed_lit([("x", "y")]), typed_lit(None), typed_lit(1.5)).first()
    assert tuple(got) == ({"a": [1, 2], "b": []}, [["x", "y"]], None, 1.5)
