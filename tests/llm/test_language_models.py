"""Language models against counts over whole texts."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pipelinekit.llm import language_models
from pipelinekit.llm.language_models import cross_entropy_difference
from pipelinekit.storage import scratch_folder


def plain_losses(rows, target, least):
    """Both models over whole texts: (words, target loss, background loss) per row."""
    split = [(t or "").encode().lower().split() for _, t in rows]
    often = Counter(w for words in split for w in words)
    named = [[w if often[w] >= least else None for w in words] for words in split]
    pairs = [list(zip(["<s>", *words], words, strict=False)) for words in named]
    counts = [Counter(p for (i, _), several in zip(rows, pairs, strict=True) if (i in target) == wanted for p in several) for wanted in (True, False)]
    totals = [sum(c.values()) for c in counts]
    kinds = sum(n >= least for n in often.values()) + 2
    prices = []
    for c, times in zip(counts, (1, totals[0] / totals[1]), strict=True):
        single, before = Counter(), Counter()
        for (a, b), n in c.items():
            single[b] += n * times
            before[a] += n * times
        one = lambda b, single=single: (single[b] + 1) / (totals[0] + kinds)
        prices.append(lambda a, b, c=c, before=before, one=one, times=times: -np.log(0.7 * c[a, b] * times / before[a] + 0.3 * one(b) if before[a] else one(b)))
    return [(len(several), *[sum(price(*p) for p in several) / len(several) if several else 0.0 for price in prices]) for several in pairs]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_language_models_equal_counts_over_whole_texts(spark, texts, least):
    target = {i for i, _ in texts if i is not None and i % 3 == 0}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"), least=least).collect()
    place = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    want = [(i, *found) for (i, _), found in zip(texts, plain_losses(texts, target, least), strict=True)]
    for a, b in zip(sorted(((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in got), key=place), sorted(want, key=place), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-5), (a, b)


def test_rare_words_reach_the_score(spark):
    """A domain told by words beyond the first thousand: no word of it is frequent."""
    rows = [(i, " ".join(f"c{n}" for n in range(1100))) for i in range(3)]
    rows += [(10 + i, f"{'good' if i % 2 else 'other'}{i // 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.filter("doc_id >= 10 AND doc_id % 4 = 1").select("doc_id")
    got = {r.doc_id: r.score for r in cross_entropy_difference(docs, target).collect()}
    assert min(got[i] for i in range(11, 50, 2)) > 0 > max(got[i] for i in range(10, 50, 2))


def shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_is_moved_and_stored_is_a_small_multiple_of_the_texts(spark, tmp_path):
    """A row per bigram, sent by word, by context and by document, came to 3.3 times these texts; slabs and parts come to 1.4."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n:x}" for n in rng.zipf(1.3, 400) % 200_000) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = shuffled(spark)
    with scratch_folder(spark, "moved") as folder:
        cross_entropy_difference(docs, docs.filter("doc_id % 3 = 0").select("doc_id")).write.parquet(f"{tmp_path}/scores")
    files = sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*.parquet"))
    assert shuffled(spark) - before + files < 2 * sum(map(len, texts))


@pytest.mark.parametrize("least, size", [(1, None), (2, None), (1, 60), (3, 60)])
def test_counts_meet_across_slabs(spark, monkeypatch, least, size):
    """A slab for every thousand rows: the same results as from one, and as from counts over whole texts."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{n}" for n in rng.zipf(1.5, rng.integers(0, 12)) % 500)) for i in range(3500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    target = docs.filter("doc_id % 5 = 0").select("doc_id")
    scored = lambda: {r.doc_id: r[1:] for r in cross_entropy_difference(docs, target, least=least, size=size).collect()}
    one = scored()
    monkeypatch.setattr(language_models, "SLAB_WORDS", 1)
    monkeypatch.setattr(language_models, "PART_HASHES", 100)
    many = scored()
    assert len(many) == len(rows) and all(np.allclose(many[i], one[i]) for i in one)
    if size is None:
        want = plain_losses(rows, {i for i, _ in rows if i % 5 == 0}, least)
        assert all(np.allclose(one[i][:3], found, atol=1e-5) for (i, _), found in zip(rows, want, strict=True))


def test_many_short_texts(spark):
    """More rows than one of the bitmaps has bits for: each is marked by its own key."""
    docs = spark.range(0, 40_000, 1, 1).selectExpr("id AS doc_id", "IF(id % 4 = 1, 'good word', IF(id % 4 = 3, '', 'other word')) AS text")
    got = cross_entropy_difference(docs, docs.filter("doc_id % 4 = 1").select("doc_id")).selectExpr("doc_id % 4 AS kind", "sign(score) AS sign").groupBy("kind", "sign").count().collect()
    assert sorted(map(tuple, got)) == [(0, -1.0, 10_000), (1, 1.0, 10_000), (2, -1.0, 10_000), (3, 0.0, 10_000)]
