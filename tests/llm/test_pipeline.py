"""The stages after one another, on rows whose fate is known."""

from __future__ import annotations

import random

import corpus_pipeline


def write(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_every_decision_takes_effect(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    docs = {i: prose(rng.randrange(80, 160)) for i in range(120)}
    junk = {i: prose(90).upper().replace(" ", "!! ") for i in range(200, 240)}
    copies = {300: docs[3], 301: docs[3], 302: docs[4]}
    item = prose(40)
    leaked = {400: f"{prose(50)} {item} {prose(40)}"}
    personal = {500: f"{prose(60)} write to some.one@example.org now {prose(30)}"}
    every = docs | junk | copies | leaked | personal
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in every.items()]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(200, 240, 2)]
    write(spark, tmp_path, rows, labels, [(1, item)])

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append({r.doc_id: r.text for r in now.collect()})
    assert set(left[0]) == set(every) - set(junk)
    assert set(left[1]) == set(left[0]) - {300, 301, 302}
    assert set(left[2]) == set(left[1]) - {400}
    assert set(left[3]) == set(left[2]) and left[3][500] == personal[500].replace("some.one@example.org", "[EMAIL]")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left[3])


def test_an_empty_corpus(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_pass_through(spark, tmp_path, texts):
    write(spark, tmp_path, [(i, t, None, None, None) for i, t in texts], [(1, 1, 0), (2, 0, 0)], [(1, None)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
