"""The Merkle manifest against trees of lists."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pipelinekit.llm import manifest
from pipelinekit.llm.manifest import ascii_lower, folded, leaf, merkle_proofs, siblings


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and what lies left and right on the way of each leaf."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(start, min(start + 8, len(nodes))) for start in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for i in below[k]:
                    paths[i].append(("".join(nodes[run.start : k]), "".join(nodes[k + 1 : run.stop])))
        below = [[i for k in run for i in below[k]] for run in runs]
        nodes = [digest(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def expected(rows):
    """(key, group, leaf) to (key, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for key, group, leaf_ in rows:
        groups[group].append((key is not None, key or 0, leaf_))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([m[2] for m in sorted(groups[g])]) for g in order]
    root, ends = tree([t[0] for t in trees])
    return sorted(
        (str(m[1] if m[0] else None), m[2], subroot, root, path + ends[i])
        for i, (g, (subroot, paths)) in enumerate(zip(order, trees, strict=True))
        for m, path in zip(sorted(groups[g]), paths, strict=True)
    )


def found(df):
    return sorted((str(r["key"]), r["leaf"], r["subroot"], r["root"], [tuple(level) for level in r["path"]]) for r in df.collect())


SHAPES = {
    "a row": [(1, "x", digest("1"))],
    "null group and keys": [(None, None, digest("1")), (None, None, digest("2")), (3, "", digest("3"))],
    "runs of one": [(i, "a", digest(str(i))) for i in range(9)] + [(i, "b", digest(str(i))) for i in range(65)],
    "many groups": [(i, f"g{i % 70}" if i % 5 else "é", digest(str(i))) for i in range(400)],
    "ties": [(i // 4, "a", digest(str(i // 2))) for i in range(30)],
    "tiers": [(i, "hot" if i % 3 else f"g{i % 4}", digest(str(i))) for i in range(700)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("levels", [1, 4])
def test_trees(spark, monkeypatch, shape, levels):
    """Also in tiers of one level, so that a chunk is one run."""
    if levels == 1 and len(SHAPES[shape]) < 100:
        pytest.skip("one tier")
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "CHUNK", 8**levels)
    df = spark.createDataFrame(SHAPES[shape], "key long, g string, leaf string").repartition(3)
    assert found(merkle_proofs(df, "g", ["key"])) == expected(SHAPES[shape])


def test_a_change_shows(spark, documents, texts):
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = documents.withColumn("leaf", leaf(*columns, F.col("text"))).withColumn("seen", leaf(*columns, ascii_lower(F.col("text"))))
    proofs = merkle_proofs(rows, "lang", ["doc_id"])
    checked = proofs.select("*", folded(F.col("leaf"), "path").alias("same"), folded(F.col("seen"), "path").alias("other")).collect()
    assert len(checked) == len(texts)
    for row in checked:
        changed = any("A" <= c <= "Z" for c in row["text"] or "")
        assert row["same"] == row["root"] and (row["other"] == row["root"]) == (not changed)
    assert any(row["other"] != row["root"] for row in checked)


def test_values_of_a_leaf(spark):
    df = spark.createDataFrame([(None, "é", 12), (1, None, None), (2, "", 0)], "a long, b string, c long")
    got = {r[0] for r in df.select(leaf(F.col("a"), F.col("b"), F.col("c"))).collect()}
    assert got == {digest("-2:é2:12"), digest("1:1--"), digest("1:20:1:0")}


def test_lower_case_of_ascii_only(spark):
    df = spark.createDataFrame([("ABC xyz",), ("ÄBCİ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()] == ["abc xyz", "Äbcİ", "", None]


def test_siblings_are_one_text(spark):
    df = spark.createDataFrame([([("a", "b"), ("", "c")],), ([],)], "p array<struct<left:string,right:string>>")
    assert [r[0] for r in df.select(siblings("p")).collect()] == ["abc", ""]


def test_nothing(nothing):
    rows = nothing.withColumn("leaf", F.col("text"))
    assert merkle_proofs(rows, "lang", ["doc_id"]).collect() == []
