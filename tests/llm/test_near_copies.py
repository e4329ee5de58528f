"""Near copies of the pipeline against all pairs of shingle sets."""

from __future__ import annotations

import glob
import random

import corpus_pipeline
from pipelinekit.llm.near_copies import one_of_near_copies
from pipelinekit.storage import scratch_folder


def shingles(text):
    found = text.split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def test_copies_beyond_three_bits_go(spark):
    rng = random.Random(9)
    prose = lambda: [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = []
    for i in range(30):
        words = prose()
        docs.append((i, " ".join(words)))
        for n, changes in enumerate((1, 3, 8, 40)):
            other = list(words)
            for at in rng.sample(range(200), changes):
                other[at] = f"x{rng.randrange(10**6)}"
            docs.append((1000 + 10 * i + n, " ".join(other)))
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    want = {i for i in sets if root[i] == i}
    assert 60 <= len(want) < 120
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, frame, "").collect()} == want


def test_awkward_rows(documents, nothing, texts):
    kept = one_of_near_copies(documents)
    assert kept.columns == documents.columns and one_of_near_copies(nothing).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 3 and len(set(ids) - {None}) == len(ids) - 3


def test_copies_within_a_template_go(spark):
    """Texts of one long template have most bands in common; each has one copy, and is alike to no other text by 0.8."""
    rng = random.Random(4)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(260)
    docs = []
    for i in range(150):
        text = template + fresh(48)
        docs.append((i, " ".join(text)))
        docs.append((1000 + i, " ".join(text[:-30] + fresh(31))))
    sets = {i: shingles(t) for i, t in docs}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(alike(i, 1000 + i) >= 0.8 for i in range(150)) and max(alike(i, j) for i in range(40) for j in range(i)) < 0.8
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in one_of_near_copies(frame).collect()}
    assert got == set(range(150))


def stored_rows(spark, folder, name):
    """Rows of the tables stored below a folder whose names begin so."""
    found = glob.glob(f"{folder.removeprefix('file:')}/{name}-*")
    assert found
    return sum(spark.read.parquet(path).count() for path in found)


def test_shingles_shared_by_chance_propose_no_pairs(spark):
    """Long texts of which any two have a shingle in common that no third has: no sets are fetched for them, but for the one pair of copies."""
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = {(i, j): fresh(5) for j in range(60) for i in range(j)}
    docs = []
    for i in range(60):
        words = fresh(2500)
        for j in set(range(60)) - {i}:
            words[40 * j : 40 * j + 5] = shared[min(i, j), max(i, j)]
        docs.append((i, " ".join(words)))
    other = docs[7][1].split()
    for at in range(0, 2500, 250):
        other[at + 20] = "another"
    docs.append((100, " ".join(other)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    with scratch_folder(spark, "near-copies") as folder:
        got = {r.doc_id for r in one_of_near_copies(frame).collect()}
    assert got == set(range(60))
    assert stored_rows(spark, folder, "candidates") <= 3 and stored_rows(spark, folder, "shingles") <= 6


def test_pairs_of_any_sizes_are_found(spark):
    """Similar pairs that no band and no fingerprint need propose: sizes and what is left out vary to the very bound."""
    rng = random.Random(12)
    docs = []
    for i in range(150):
        words = [f"u{rng.randrange(10**9)}" for _ in range(rng.choice([5, 9, 14, 30, 80, 300, 900]))]
        size = len(words) - 4
        left = rng.choice([0, int(size * 0.2) - 1, int(size * 0.2), int(size * 0.2) + 1])
        docs += [(i, " ".join(words)), (1000 + i, " ".join(words[max(0, left) :]))]
    sets = {i: shingles(t) for i, t in docs}
    alike = {i for i in range(150) if len(sets[i] & sets[1000 + i]) >= 0.8 * len(sets[i] | sets[1000 + i])}
    assert 80 < len(alike) < 140
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in one_of_near_copies(frame).collect()}
    assert got == set(range(150)) | {1000 + i for i in range(150) if i not in alike}
