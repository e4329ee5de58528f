"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pipelinekit.llm import variants
from pipelinekit.llm.variants import spelled_words, spelling_variants


def one_edit(a: str, b: str) -> bool:
    """Whether an insertion, deletion or replacement turns one into the other, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts: dict[str, int]) -> set[tuple]:
    near = defaultdict(list)
    for a in counts:
        near[a] = [b for b in counts if abs(len(a) - len(b)) < 2 and one_edit(a, b)]
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * n else None

    def root(word: str) -> str:
        return word if form[word] is None else root(form[word])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(3)
    found = {}
    for _ in range(350):
        word = [rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))]
        for n in (rng.randrange(1, 400), 40, 8, 1):
            found.setdefault("".join(word), n)
            at = rng.randrange(len(word))
            kind = rng.randrange(3)
            word[at : at + (kind < 2)] = [rng.choice("abcxyzé")] if kind else []
    return found | {"": 3, "a": 20, "ab": 100, "ba": 100, "b": 2}


@pytest.mark.parametrize(("cell", "searches"), [(25, 60), (16_000, 40_000)])
def test_all_pairs(spark, counts, monkeypatch, cell, searches):
    """Cut into many cells, and with a cell for each length."""
    monkeypatch.setattr(variants, "CELL", cell)
    monkeypatch.setattr(variants, "SEARCHES", searches)
    got = [tuple(r) for r in spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    assert len(got) == len(counts) and set(got) == expected(counts)


def test_a_word_with_very_many_near_words(spark, monkeypatch):
    """One form next to a thousand words, and many words of the same letters."""
    monkeypatch.setattr(variants, "CELL", 100)
    rng = random.Random(5)
    words = {"abcdefgh": 100_000}
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xE0, 0xF6)]
    for at in range(8):
        words |= {f"abcdefgh"[:at] + c + "abcdefgh"[at + 1 :]: 7 for c in letters if c != "abcdefgh"[at]}
    while len(words) < 1000:
        words.setdefault("".join(rng.sample("abcdefgh", 8)), 5)
    got = {tuple(r) for r in spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == expected(words)


def test_words(documents, texts):
    wanted = Counter()
    for name, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if run:
                wanted[run] += 1
    got = spelled_words(documents, drop=3).collect()
    assert len(got) == len(wanted) and {r["word"]: r["n"] for r in got} == wanted


def test_nothing(spark, nothing):
    assert spelled_words(nothing).collect() == []
    assert spelling_variants(spelled_words(nothing)).collect() == []
