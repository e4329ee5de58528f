from __future__ import annotations

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from pipelinekit.catalog.sources import json_documents
from pipelinekit.operators.running import numbered
from pipelinekit.sources import DatasetSpec, fixture_frame, read, write
from pipelinekit.storage import scratch_folder, scratch_path, shared_dir, stored

ORDERS = {
    "format": "csv", "path": "/nowhere", "writeMode": "error", "separator": "|", "header": True, "useSchema": True,
    "ignoreLeadingWhiteSpaceReading": False, "ignoreTrailingWhiteSpaceReading": True,
    "ignoreLeadingWhiteSpaceWriting": True, "ignoreTrailingWhiteSpaceWriting": True, "nullValue": None, "inferSchema": None,
    "partitionColumns": None, "datasetType": "File", "description": "", "mode": None, "quoteAll": True,
    "schema": {"type": "struct", "fields": [
        {"name": "order_id", "type": "integer", "nullable": True, "metadata": {"description": "key", "tags": []}},
        {"name": "status", "type": "string"}, {"name": "amount", "type": "double", "nullable": True, "metadata": {}},
    ]},
}


def test_document_options():
    spec = DatasetSpec.from_document(ORDERS)
    assert spec.read_options() == {"sep": "|", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": True, "quoteAll": True}
    assert spec.write_options() == {"sep": "|", "header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "quoteAll": True}
    assert spec.schema.simpleString() == "struct<order_id:int,status:string,amount:double>"
    assert spec.schema["order_id"].metadata == {"description": "key", "tags": []}
    assert DatasetSpec.from_document({**ORDERS, "useSchema": False}).schema is None
    assert DatasetSpec.from_document({**ORDERS, "writeMode": None}).write_mode is None
    assert "mode" not in DatasetSpec.from_document({**ORDERS, "mode": "FAILFAST"}).write_options()
    assert DatasetSpec.from_document({**ORDERS, "mode": "FAILFAST"}).read_options()["mode"] == "FAILFAST"


def test_csv_by_spec(spark, rows, tmp_path):
    spec = DatasetSpec.from_document(ORDERS).at(str(tmp_path / "orders"))
    df = spark.createDataFrame([(1, "  open ", 1.5), (2, None, None)], "order_id int, status string, amount double")
    write(df, spec)
    text = "".join(p.read_text() for p in sorted((tmp_path / "orders").glob("*.csv")))
    assert '"order_id"|"status"|"amount"' in text
    assert rows(read(spark, spec)) == [(1, "open", 1.5), (2, None, None)]
    with pytest.raises(AnalysisException):
        write(df, spec)  # the mode says error
    with pytest.raises(AnalysisException):
        write(df, DatasetSpec("csv", spec.path))  # and so does no mode


def test_short_schema_and_trimming(spark, rows, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b,c,d\n1, x ,2.5,9\n3,y,,9\n")
    three = StructType.fromDDL("a int, b string, c double")
    assert rows(read(spark, DatasetSpec("csv", str(path), {"header": True}, three))) == [(1, " x ", 2.5), (3, "y", None)]
    trimmed = {"header": True, "ignoreLeadingWhiteSpaceReading": True, "ignoreTrailingWhiteSpaceReading": True}
    assert rows(read(spark, DatasetSpec("csv", str(path), trimmed, three)), "b") == [("x",), ("y",)]
    names = read(spark, DatasetSpec("csv", str(path), {"header": True}))
    assert names.dtypes == [(c, "string") for c in "abcd"]


def test_partitioned_parquet_and_json_lines(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "`a-b` int, p string")
    parquet = DatasetSpec("parquet", str(tmp_path / "pq"), {"mergeSchema": True}, None, "overwrite", ["p"])
    write(df, parquet)
    write(df, parquet)
    assert sorted(p.name for p in (tmp_path / "pq").iterdir() if p.is_dir()) == ["p=x", "p=y"]
    assert rows(read(spark, parquet)) == [(1, "x"), (2, "y")]
    lines = DatasetSpec("json", str(tmp_path / "js"), {}, StructType.fromDDL("`a-b` int, p string"), "overwrite")
    write(df, lines)
    assert rows(read(spark, lines)) == [(1, "x"), (2, "y")]


def test_multi_line_json(spark, rows, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"result": {"count": "1", "events": [{"date": "d", "lang": None}]}}, indent=2))
    schema = StructType.fromDDL("result struct<count:string, events:array<struct<`date`:string, lang:string>>>")
    df = read(spark, DatasetSpec("json", str(tmp_path / "old.json"), {"multiLine": True}, schema))
    assert rows(df.selectExpr("result.count", "result.events[0].date", "size(result.events)")) == [("1", "d", 1)]


def test_sorted_order_survives_the_write(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as v").repartition(8).orderBy("v")
    write(df, DatasetSpec("csv", str(tmp_path / "s"), {"header": False}, None, "overwrite"))
    files = sorted((tmp_path / "s").glob("part-*.csv"))
    values = [int(line) for f in files for line in f.read_text().split()]
    assert values == sorted(values) and len(values) == 1000


def test_fixture_frame(spark, rows):
    schema = {"type": "struct", "fields": [{"name": n, "type": "string"} for n in ("customer_id", "first_name", "phone", "flags")]}
    data = {"values": [["555-0100", "17", "Ada"]], "columns": ["phone", "customer_id", "first_name"]}
    df = fixture_frame(spark, schema, data)
    assert df.columns == ["customer_id", "first_name", "phone", "flags"]
    assert rows(df) == [("17", "Ada", "555-0100", None)]
    with pytest.raises(ValueError, match="other"):
        fixture_frame(spark, schema, {"values": [], "columns": ["other"]})


def test_scratch_lies_in_the_named_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_a_folder_for_what_is_stored(spark):
    """What is stored inside lies below the folder, also of a folder within; nothing else does."""
    rows = spark.range(5)
    with scratch_folder(spark, "work") as folder:
        inside = numbered(rows, ["id"], ["id"])
        with scratch_folder(spark, "part") as part:
            deeper = stored(rows)
    outside = stored(rows)
    lies = lambda df, where: all(f"{where}/" in path for path in df.inputFiles())
    assert part.startswith(f"{folder}/") and lies(inside, folder) and lies(deeper, part) and not lies(outside, folder)
    assert [df.count() for df in (inside, deeper, outside)] == [5, 5, 5]


def test_json_documents_share_files(spark, rows, tmp_path):
    """Many documents to a file, and none lost: equal and null ids too."""
    suppliers = spark.range(0, 2500, 1, 1).selectExpr("IF(id % 5 = 0, NULL, id div 2) AS s_suppkey", "concat('S \"', id, '\"') AS s_name")
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    with scratch_folder(spark, "json") as folder:
        got = rows(json_documents(spark, str(tmp_path)))
    read = spark.read.parquet(str(tmp_path / "supplier.parquet")).collect()
    key = lambda row: None if row.s_suppkey is None else str(row.s_suppkey)
    want = [(kind, "by", "2024-01-01", key(row)) for row in read for kind in (row.s_name, "all")]
    assert got == sorted(want, key=lambda row: [(value is not None, str(type(value)), value) for value in row])
    assert len(list(Path(folder).glob("documents-*/part-*"))) == 3


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_storing_leaves_no_shuffle_files(spark, rows):
    """The files of a shuffle go with the write that needed it, not only when the driver collects its garbage; the session is as before."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    both = counts.join(counts.withColumnRenamed("count", "again").hint("merge"), "k")
    kept = [stored(both), stored(both)]
    until = time.monotonic() + 20
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting) == was
    assert rows(kept[0]) == rows(kept[1]) == rows(both) and len(rows(both)) == 7
    with pytest.raises(AnalysisException):
        stored(both.select("k", F.col("k").alias("K")))
    assert spark.conf.get(setting) == was
