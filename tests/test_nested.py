from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from pipelinekit.functions import nested
from pipelinekit.functions.text import jar_version


def one(spark, text):
    return spark.createDataFrame([(text,)], "j string")


SUBSCRIBED = "gitUri=http://git/a.git&subPath=&tag=Hello/x-1.0&projectSubscriptionProjectId={}&path=pipelines/p"


def job(**processes):
    return json.dumps({"processes": {k: {"component": c, "properties": p} for k, (c, p) in processes.items()}})


def test_references_of_either_shape(spark, rows):
    texts = [
        job(a=("Pipeline", {"pipelineId": SUBSCRIBED.format(12)}), b=("Pipeline", {"pipelineId": "pipelines/local"})),
        job(a=("Pipeline", {"pipelineId": {"type": "literal", "value": SUBSCRIBED.format(13)}})),
        job(a=("Pipeline", {"pipelineId": {"type": "expression", "value": SUBSCRIBED.format(14)}}), b=("Script", {})),
        json.dumps({"components": [{"PipelineComponent": {"pipelineId": SUBSCRIBED.format(15)}}, {"Script": {}}]}),
        job(a=("Pipeline", {"pipelineId": [SUBSCRIBED.format(16)]})),
        "no json", "[]", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts + texts], "j string")
    assert rows(nested.json_refs(df, "j")) == [("12",), ("13",), ("15",)]
    assert rows(nested.entities_of_kind(df, "j", "Pipeline")) == sorted(
        [(SUBSCRIBED.format(12),), (SUBSCRIBED.format(13),), ("pipelines/local",)]
    )


def test_entity_places(spark, rows):
    text = job(
        a=("Pipeline", {"pipelineId": "p1", "clusterSize": "f1/small"}),
        b=("Pipeline", {"pipelineId": {"type": "literal", "value": "p2"}, "clusterSize": "f2"}),
        c=("Pipeline", {"pipelineId": "p3"}),
        d=("Pipeline", {"clusterSize": "f4/x"}),
        e=("Pipeline", {"pipelineId": "", "clusterSize": "f5/x"}),
        f=("Pipeline", {"pipelineId": "p6", "clusterSize": ""}),
    )
    assert rows(nested.entity_places(one(spark, text), [], "j")) == [("p1", "f1"), ("p2", "f2")]


@pytest.mark.parametrize(("index", "repo"), [(None, None), ("https://index/private/", "https://index/private/simple")])
def test_wheels_to_packages(spark, index, repo):
    kind = "array<struct<maven:struct<coordinates:string>,pypi:struct<package:string,repo:string>,whl:string>>"
    libraries = [
        {"whl": "s3://shelf/plain.whl"},
        {"whl": "s3://shelf/a/b/pipeline/night_load-7.2-py3-none-any.whl"},
        {"pypi": {"package": "numbers>3"}},
        {"maven": {"coordinates": "org.example:tool:9"}},
    ]
    df = one(spark, json.dumps(libraries)).select(F.from_json("j", kind).alias("l"))
    out = df.select(F.to_json(nested.wheels_to_packages(F.col("l"), index))).first()[0]
    package = {"package": "night_load==7.2", **({"repo": repo} if repo else {})}
    assert json.loads(out) == [libraries[0], {"pypi": package}, *libraries[2:]]


def test_drop_nulls_at_every_depth(spark):
    kind = "struct<a:string,b:struct<c:int,d:array<struct<e:int,f:string>>>,m:map<string,array<int>>,n:array<array<string>>>"
    values = [
        {"a": None, "b": {"c": None, "d": [None, {"e": 1, "f": None}, {"e": None, "f": None}]}, "m": {"x": None, "y": [1, None]}, "n": [None, ["p", None]]},
        {"a": "s", "b": None, "m": {}, "n": []},
        {"b": {"c": 3, "d": None}},
    ]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string").select(F.from_json("j", kind).alias("v"))
    got = [json.loads(r[0]) for r in df.select(nested.drop_nulls_json(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [
        {"b": {"d": [{"e": 1}, {}]}, "m": {"y": [1]}, "n": [["p"]]},
        {"a": "s", "m": {}, "n": []},
        {"b": {"c": 3}},
    ]


def test_flatten(spark, rows):
    kind = "result struct<count:string,events:array<struct<category1:string,date:string>>>"
    df = spark.createDataFrame([(("2", [("a", "d1"), ("b", None), None]),), (("0", []),), (("0", None),), (None,)], kind)
    flat = nested.flatten(df)
    assert flat.columns == ["result-count", "result-events-category1", "result-events-date"]
    assert rows(flat) == sorted(
        [("2", "a", "d1"), ("2", "b", None), ("2", None, None), ("0", None, None), ("0", None, None), (None, None, None)],
        key=lambda r: [(v is not None, v) for v in r],
    )
    assert nested.flatten(df, ["result-events-date"]).columns == ["result-events-date"]


def test_item_helpers(spark, rows):
    df = spark.createDataFrame(
        [(1, ["a", "b", "a", None], {"p": ("Model",), "q": ("Pipeline",)}), (2, [], {}), (3, None, None)],
        "i int, a array<string>, m map<string, struct<component:string>>",
    )
    allowed = F.array(F.lit("a"), F.lit("c"))
    assert rows(df.select("i", nested.items_allowed(F.col("a"), allowed))) == [(1, ["a", "a"]), (2, []), (3, None)]
    assert rows(df.select("i", nested.has_component(F.col("m"), "Model"))) == [(1, True), (2, False), (3, False)]
    comps = spark.createDataFrame(
        [(1, [("x", None), (None, "y"), ("z", None)]), (2, [(None, "y")]), (3, None)], "i int, c array<struct<s:string,d:string>>"
    )
    assert rows(nested.components_of_kind(comps, "c", "s", drop_empty=False)) == [(1, ["x", "z"]), (2, []), (3, [])]
    assert rows(nested.components_of_kind(comps, "c", "s", drop_empty=True)) == [(1, ["x", "z"])]


def test_any_flag(spark):
    df = spark.createDataFrame([(False, None), (None, None), (True, False)], "a boolean, b boolean")
    flags = {"a": F.col("a"), "b": F.col("b"), "either": F.col("a") | F.col("b")}
    assert nested.any_flag(df, flags).first().asDict() == {"a": True, "b": False, "either": True}
    assert nested.any_flag(df.filter("false"), flags).first().asDict() == {"a": False, "b": False, "either": False}


def test_task_versions(spark, rows):
    df = spark.createDataFrame(
        [
            ([("n1", "p1"), ("n2", "p2"), ("", "p3"), ("n9", "p9")],
             [("n1", ["a_2.12.jar", "b_2.13.jar", "c.jar"]), ("n2", None), ("n1", ["d_2.12.jar"])]),
            ([("n1", "p1")], [("n2", ["x_2.12.jar"])]),
        ],
        "c array<struct<node:string,entity:string>>, t array<struct<task_key:string,files:array<string>>>",
    )
    assert rows(nested.task_versions(df, "c", "t", jar_version)) == [("p1", "2.12"), ("p1", "2.13")]


def test_references_at_any_depth_and_of_any_shape(spark, rows):
    ref = lambda n: {"pipelineId": SUBSCRIBED.format(n)}
    texts = [
        json.dumps({"a": {"b": [{"c": [ref(21)]}, [ref(22)]]}, "note": 'say , "pipelineId": "x" and \\'}),
        json.dumps({"processes": {"x": "text", "p": {"properties": ref(23)}}}, indent=2),
        json.dumps([ref(24), {"pipelineId": {"type": "literal", "value": SUBSCRIBED.format(25), "of": 1}}]),
        json.dumps({"pipelineId": {"type": "expression", "value": SUBSCRIBED.format(26)}, "other": {"pipelineId": 27}}),
        json.dumps({"text": json.dumps(ref(28)), "pipelineIds": SUBSCRIBED.format(29)}),
        '{"pipelineId": broken',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert rows(nested.json_refs(df, "j")) == [("21",), ("22",), ("23",), ("24",), ("25",)]
    numeric = job(a=("Pipeline", {"pipelineId": 12, "clusterSize": "f1/x"}), b=("Pipeline", {"pipelineId": "p", "clusterSize": "f2"}))
    assert rows(nested.entity_places(one(spark, numeric), [], "j")) == [("p", "f2")]
    mixed = json.dumps({"processes": {"x": "text", "p": {"component": "Pipeline", "properties": {"pipelineId": "q"}}}})
    assert rows(nested.entities_of_kind(one(spark, mixed), "j", "Pipeline")) == [("q",)]


def test_references_that_hold_other_objects(spark, rows):
    name = SUBSCRIBED.format
    deep = {"type": "literal", "value": name(31), "more": {"x": [{"pipelineId": name(32)}, "}"]}}
    texts = [
        json.dumps({"a": [{"pipelineId": deep}, {"pipelineId": {"items": [{}], "type": "literal", "value": name(33)}}], "z": {"value": name(34)}}),
        json.dumps({"pipelineId": {"type": "literal", "value": {"value": name(35)}}, "b": {"pipelineId": {"type": "expression", "value": name(36), "y": {}}}}),
        json.dumps({"pipelineId": {"inner": {"type": "literal", "value": name(37)}}, "type": "literal", "value": name(38)}),
        json.dumps({"pipelineId": {"inner": {"type": "x"}, "type": "literal", "value": 39}}),
    ]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    # Nothing is looked for below a reference.
    assert rows(nested.json_refs(df, "j")) == [("31",), ("33",)]


def test_many_references_in_one_document(spark, rows):
    """Time grows with the document, also where every reference is an object holding objects, and where it is very deep."""
    wide = json.dumps([{"pipelineId": {"a": {"b": {}}, "type": "literal", "value": SUBSCRIBED.format(i)}} for i in range(6000)])
    deep = "[" * 900 + json.dumps({"pipelineId": SUBSCRIBED.format("d")}) + "]" * 900
    df = spark.createDataFrame([(wide,), (deep,), ("[" * 100_000,), (None,)], "j string")
    start = time.monotonic()
    assert nested.json_refs(df, "j").count() == 6001
    assert time.monotonic() - start < 15


def test_one_pass_of_references(spark):
    """Values of every kind under the key, and brackets, quotes and keys inside of strings."""
    cases = [
        ('{"pipelineId": ["x", {"pipelineId": "no"}], "pipelineId2": "no", "a": {"pipelineId": "yes"}}', ["yes"]),
        ('[{"type": "literal", "value": "no"}, {"pipelineId": "a"}, {"pipelineId": {"type": "literal", "value": "b"}}, {"pipelineId": "c"}]', ["a", "b", "c"]),
        ('{"pipelineId": {"type": "literal", "x": {"value": "no"}, "y": [{"type": "z"}]}}', []),
        ('{"pipelineId": {"type": {"literal": 1}, "value": "no"}, "q": {"pipelineId": {"value": "no"}}}', []),
        ('{"pipelineId": {"x": "}{", "type": "literal", "value": "q\\"u{o\\u00e9"}}', ['q"u{o\u00e9']),
        ('{"k": "{\\"pipelineId\\": \\"no\\"", "pipelineId": "back\\\\"}', ["back\\"]),
        ('{"pipelineId": {"type": "literal", "value": 5}, "z": {"pipelineId": true}}', []),
        ('"pipelineId"', []),
        ('{"pipelineId"', None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(nested.given_references(F.col("j"))).collect()]
    assert got == [want for _, want in cases]


def test_one_parse(spark):
    """All places of a job document are read from one parse, in the JVM."""
    df = spark.createDataFrame([("jobs/a.json", "{}")], "p string, j string").select(nested.document_references(F.col("p"), F.col("j")).alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 1 and "from_json" not in plan and "Python" not in plan


def test_many_components_and_tasks(spark):
    """Two thousand of each in one row."""
    names = [f"n{i}" for i in range(2000)]
    df = spark.createDataFrame(
        [([(n, f"e{n}") for n in names], [(n, [f"{n}_2.12.jar"]) for n in names])],
        "c array<struct<node:string,entity:string>>, t array<struct<task_key:string,files:array<string>>>",
    )
    assert nested.task_versions(df, "c", "t", jar_version).count() == 2000
    assert "Join" not in nested.task_versions(df, "c", "t", jar_version)._jdf.queryExecution().executedPlan().toString()


def test_stale_shapes(spark):
    wrapped = lambda kind: {"type": kind, "value": "v"}
    library = {"PipelineComponent": {"pipelineId": "l"}}
    cases = [
        ({"processes": {"x": "text", "p": {"properties": {"pipelineId": wrapped("expression")}}}}, ["v"]),
        ({"processes": {"p": {"properties": {"pipelineId": 5}}}}, []),
        ({"components": [{"PipelineComponent": {"pipelineId": wrapped("literal")}}, library]}, ["l"]),
        ({"components": [], "request": {"tasks": [{"libraries": [library]}, {}]}}, ["l"]),
        ({"components": [], "request": {"CreateNewJobRequest": {"tasks": [{"libraries": [{"x": 1}, library]}]}}}, ["l"]),
        ({"request": {"tasks": [{"libraries": [library]}]}}, []),
        ({"processes": []}, None),
        ({"components": {}}, None),
        ({"processes": {"p": {"properties": "text"}}}, None),
        ({"components": [library, {"PipelineComponent": "text"}]}, None),
        ({"processes": {"p": {"properties": {"pipelineId": {"value": ["v"]}}}, "q": {"properties": {"pipelineId": "t"}}}}, ["t"]),
        ([], []),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(nested.process_references(F.try_parse_json("j"))).collect()]
    assert got == [want for _, want in cases]


def test_arrays_side_by_side(spark, rows):
    kind = "k int, a array<struct<x:int>>, b array<string>"
    df = spark.createDataFrame([(1, [(1,), (2,), (3,)], ["p", "q"]), (2, None, ["r"]), (3, [], None)], kind)
    assert rows(nested.flatten(df)) == [(1, 1, "p"), (1, 2, "q"), (1, 3, None), (2, None, "r"), (3, None, None)]
