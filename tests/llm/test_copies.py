"""Fingerprints, components and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from pipelinekit.llm.components import components
from pipelinekit.llm.simhash import links, one_of_each, simhash_components
from pipelinekit.llm.substrings import dedup_substrings, planes, rolling, steps, unplaned, unstepped

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(values, distance=3):
    """The smallest index reached from each value, by all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_components_of_documents(documents, texts):
    rows = [(i, simhash(t)) for i, t in texts]
    found, least = groups([f for _, f in rows]), {}
    for g, (i, _) in zip(found, rows, strict=True):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(least[g], i)
    want = Counter((i, f"{f:016x}", least[g]) for g, (i, f) in zip(found, rows, strict=True))
    got = simhash_components(documents).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    stays = {i for (i, _, c) in want if i is not None and i == c}
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter(stays)
    assert ids.count(None) == 3


def test_all_links_among_crowded_fingerprints(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(20):
        centre = rng.getrandbits(64)
        for _ in range(60):
            value = centre
            for _ in range(rng.randrange(7)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = links(spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(3))
    assert edges.count() < 16 * len(values)
    root = {r.node: r.root for r in components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for v, s, g in zip(values, signed, groups(values), strict=True):
        got[root.get(s, s)].add(v)
        want[g].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 400)] + [(7, 7), (9, 8), (8, 9), (None, 3)]
    random.Random(1).shuffle(edges)
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect() if r.node != r.root}
    assert root == {i: 100 for i in range(101, 161)} | {i: 300 for i in [*range(301, 400), 500]} | {9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def without_repeats(rows, size=13):
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if i is not None:
                first[window] = min(first.get(window, i), i)
    out = Counter()
    for i, words in split:
        gone = {k + j for k in range(len(words) - size + 1) if i is not None and first[tuple(words[k : k + size])] < i for j in range(size)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_repeated_passages(documents, texts):
    got = dedup_substrings(documents).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.n_words, r.n_removed, digest(r.kept_text)) for r in got) == without_repeats(texts)
    for r in got:
        spans = [(s.start, s.end) for s in r.intervals]
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_rolling_hashes_are_polynomials():
    values = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    for size in (1, 2, 5, 13, 16):
        want = [sum(int(values[i + j]) * base ** (size - 1 - j) for j in range(size)) % 2**64 for i in range(60 - size + 1)]
        assert rolling(values, size).tolist() == want
    assert len(rolling(values[:5], 13)) == 0


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500, 200_000):
        numbers = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert (unplaned(planes(numbers)) == numbers).all()
        assert (unstepped(steps(np.sort(numbers))) == np.sort(numbers)).all()
        signed = rng.integers(-(2**63), 2**63, n)
        assert (unplaned(planes(signed)).view(np.int64) == signed).all()


def test_no_documents(nothing):
    assert simhash_components(nothing).count() == dedup_substrings(nothing).count() == one_of_each(nothing).count() == 0
