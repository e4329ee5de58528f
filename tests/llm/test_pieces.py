"""Encoding and decoding against the sentencepiece library."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pipelinekit.llm.pieces import Vocabulary, encoded

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(Path(PATH).read_bytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁abceht\n\t<>é　中😀\u0000"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    vocabulary = test_any_text.vocabulary = getattr(test_any_text, "vocabulary", None) or Vocabulary(Path(PATH).read_bytes())
    wanted = vocabulary.library.encode(text)
    assert vocabulary.encode(text) == wanted
    assert vocabulary.decode(wanted) == vocabulary.library.decode(wanted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids(ids):
    """Also bytes that are no UTF-8, controls and the unknown piece decode alike."""
    vocabulary = test_any_ids.vocabulary = getattr(test_any_ids, "vocabulary", None) or Vocabulary(Path(PATH).read_bytes())
    assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_a_long_word_without_a_blank(vocabulary):
    text = "abcde" * 40_000
    assert vocabulary.encode(text) == vocabulary.library.encode(text)


def test_a_small_cache_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr("pipelinekit.llm.pieces.CACHED_WORDS", 3)
    text = "the cat sat on the mat and the hat " * 5
    assert Vocabulary(Path(PATH).read_bytes()).encode(text) == vocabulary.library.encode(text)


def test_every_row(spark, documents, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    wanted = []
    for name, text in texts:
        ids = library.encode(text or "")
        wanted.append((name, ids, library.decode(ids) if ids else ""))
    got = [tuple(r) for r in encoded(documents, Path(PATH).read_bytes()).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_nothing(nothing):
    assert encoded(nothing, Path(PATH).read_bytes()).collect() == []


def test_a_difference_is_an_error(documents, monkeypatch):
    monkeypatch.setattr(Vocabulary, "merge", lambda self, word: [5])
    with pytest.raises(ValueError, match="merge-type"):
        Vocabulary(Path(PATH).read_bytes())


def test_known_words_need_no_surface():
    """Words of known characters are spelled by their pieces, all at once."""
    vocabulary = Vocabulary(Path(PATH).read_bytes())
    vocabulary.merged.clear()
    vocabulary.shown = {}
    vocabulary.learn(["▁hello", "hello", "▁▁there"], True)
    assert [vocabulary.merged[word][1] for word in ("▁hello", "hello", "▁▁there")] == [b" hello", b"hello", b"  there"]
