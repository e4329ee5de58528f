"""Terms that reveal rare values, wherever they stand."""

from __future__ import annotations

from pipelinekit.llm.pii import personal_data, sanitised


def corpus(spark):
    """A value in copies of one text, with a name that no other text has, and a list of values that no other text shares."""
    filler = " ".join(f"filler{n}" for n in range(30))
    rows = [(i, f"common words of row {i % 40} ann wrote {filler}") for i in range(4000)]
    rows += [(5000, f"Lee common a.b@c.de {filler} words of LEE 7x7q9 {filler} and lee.")] * 3
    rows += [(5001, f"common words {' '.join(f'v{n}@many.org' for n in range(300))} ann quill")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_rare_value_is_given_away_in_the_whole_document(spark):
    docs = corpus(spark)
    got = {r.doc_id: r.text for r in sanitised(docs).collect()}
    filler = " ".join(f"filler{n}" for n in range(30))
    # All copies of the text are one text; short names and mixed terms are terms; 'and' stands nowhere else either.
    assert got[5000] == f"[TERM] common [EMAIL] {filler} words of [TERM] [TERM] {filler} [TERM] [TERM]."
    assert got[5001] == f"common words {' '.join(['[EMAIL]'] * 300)} ann [TERM]"
    assert got[3] == f"common words of row 3 ann wrote {filler}"
    assert sum(len(r.term_spans) for r in personal_data(docs).collect()) == 3 * 5 + 1


def test_one_text_says_little_in_a_small_corpus(spark):
    docs = corpus(spark).filter("doc_id < 100 OR doc_id >= 5000")
    assert not any(r.term_spans for r in personal_data(docs).collect())
