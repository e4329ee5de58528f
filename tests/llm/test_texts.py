"""Personal data, licences, benchmark passages and language models."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np

from pipelinekit.llm import decontamination as D
from pipelinekit.llm import licenses
from pipelinekit.llm.decontamination import contaminated, decontaminated
from pipelinekit.llm.language_models import cross_entropy_difference
from pipelinekit.llm.licenses import license_scan
from pipelinekit.llm.pii import base_spans, cut_out, personal_data, sanitised, written
from pipelinekit.llm.queries import op10_license_scans, op5_pii


def plain_luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and plain_luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "..", "1", "22", "255", "256", "00000000001", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "ß", "٣", "x@y.z", "@d-e.f.g", "+1 (555) 123-4567", "10.0.0.1", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("") == []


def test_personal_data_over_documents(spark, documents, texts, nothing):
    got = personal_data(documents)
    assert got.count() == len(texts)
    assert personal_data(nothing).count() == sanitised(nothing).count() == 0
    assert sanitised(documents).columns == documents.columns


def corpus(spark):
    """Entity a@b.cd always stands with zyxomma, which is nowhere else; 'common' is everywhere."""
    rows = [(i, f"number{i % 50} common words fill this text of row {i}") for i in range(200)]
    rows += [(1000 + i, f"common {'abcdefgh'[i]} mail a@b.cd zyxomma and 10.0.0.{i} here") for i in range(6)]
    rows += [(2000, "common mail q@r.st lonely"), (2001, None), (2002, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_revealing_terms(spark):
    docs = corpus(spark)
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert len(got) == 209
    for i in range(6):
        text = f"common {'abcdefgh'[i]} mail a@b.cd zyxomma and 10.0.0.{i} here"
        at = text.index("zyxomma")
        assert [(s.start, s.end) for s in got[1000 + i].term_spans if text[s.start : s.end] == "zyxomma"] == [(at, at + 7)]
        assert "common" not in [text[s.start : s.end] for s in got[1000 + i].term_spans]
    assert not got[2000].term_spans and not got[5].spans
    clean = {r.doc_id: r.text for r in sanitised(docs).collect()}
    assert clean[2000] == "common mail [EMAIL] lonely" and clean[2001] is None and clean[2002] == ""
    assert "zyxomma" not in clean[1003] and "[EMAIL] [TERM]" in clean[1003] and clean[7] == "number7 common words fill this text of row 7"


def test_overlapping_spans_are_cut_once():
    assert cut_out("abcdefgh", [("email", 1, 4), ("phone", 3, 6)]) == "a[EMAIL]gh"
    assert cut_out("abc", []) == "abc" and cut_out(None, []) is None


def test_pii_query_digests(spark, tmp_path, texts):
    import hashlib

    rows = [*texts, (9000, "x@y.zz and +1 (555) 123-4567, 4111 1111 1111 1111 at 10.1.2.3"), (9001, "Ünïcode 😀 a@b.co")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in op5_pii(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in rows:
        spans = plain_spans(t or "")
        n = Counter(k for k, _, _ in spans)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written(spans).encode()).hexdigest()] += 1
    assert got == want


def plain_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    at = {k: [i for i in range(len(words)) if words[i : i + len(p)] == p] for k, p in phrases.items()}
    every = sorted(i for v in at.values() for i in v)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v))


def test_licences(spark, tmp_path, texts):
    more = [
        "The MIT License. MIT-license mit  License", "Apache License, apache\nlicense general public license GNU General Public License, v3",
        "Licensd under the Apache Licence, Version 2.0", "omit license", "Permission is hereby granted, free of charge, to any person obtainin a copy",
        "licensed under CC BY-SA 4.0", "İmit license mit license", "mit license " * 300,
    ]
    rows = [*texts, *[(5000 + i, t) for i, t in enumerate(more)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_license_scans(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *plain_licences(t)) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[5002].labels == "apache" and 0.8 < by[5002].score < 1 and by[5002].notices[0].edits == 2
    assert by[5004].labels == "mit" and by[5005].labels == "cc" and by[5003].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_very_long_texts_of_licences(spark):
    """Very many phrases, and very many beginnings of a notice that never goes on."""
    rows = [(1, "mit license " * 60_000), (2, "permission is hereby " * 30_000), (3, "x " * 300_000 + "mit license")]
    start = time.monotonic()
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert time.monotonic() - start < 30
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (60_000, 0, 119_998, "mit")
    assert (got[2].n_base, got[2].n_words, got[2].labels, got[2].score) == (0, 90_000, "", 0.0)
    assert (got[3].first_word, got[3].last_word) == (300_000, 300_000)


def test_notices_with_few_edits_are_found(spark):
    """Every notice, with as many edits as it allows, against the least edits of it anywhere in the text."""
    rng = random.Random(9)
    rows = []
    for n in range(300):
        label, notice = rng.choice(licenses.NOTICES)
        body = list(notice)
        for _ in range(rng.randrange(0, licenses.allowed(notice) + 3)):
            at = rng.randrange(1, len(body) - 1)
            body[at : at + rng.randrange(2)] = rng.choice(["", "x", "e"])
        rows.append((n, label, notice, f"some words {''.join(body)} and more"))
    got = {r.doc_id: r.labels.split(",") for r in license_scan(spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id int, text string")).collect()}
    for n, label, notice, text in rows:
        line = " " + " ".join(re.findall("[a-z0-9]+", text)) + " "
        # A match begins and ends at words: the notice with the blanks around it costs no more edits.
        if edit_distance_inside(f" {notice} ", line) <= licenses.allowed(notice):
            assert label in got[n], (label, text)
        if label in got[n]:
            assert any(edit_distance_inside(other, line) <= licenses.allowed(other) for kind, other in licenses.NOTICES if kind == label) or label in ("mit", "apache", "gpl")


def test_no_licences(nothing):
    assert license_scan(nothing).count() == 0


def edit_distance_inside(pattern, text):
    """Least edits of a pattern anywhere in a text, by the whole table."""
    row = np.zeros(len(text) + 1, int)
    letters = np.array(list(text))
    for i, c in enumerate(pattern, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[:-1] + (letters != c), row[1:] + 1)
        at = np.arange(len(row))
        step = np.minimum.accumulate(step - at) + at
        row = step
    return row.min()


def test_contaminated_equals_alignment_of_all_pairs(spark, documents, texts, nothing):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 60)))) for i in range(12)]
    rows = [(i, t) for i, t in texts if t is None or len(t) < 3000]
    for n in range(40):
        item = items[n % 12][1]
        part = item[: rng.randrange(60, 200)]
        letters = list(part)
        for _ in range(rng.randrange(0, 16)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], ["q"], ["z", letters[at]]])
        rows.append((8000 + n, f"{texts[n][1][:200] if texts[n][1] else ''} {'  '.join(''.join(letters).split(' ')).upper()} tail"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (50, None), (51, "short"), (None, items[0][1]), (52, "")], "item_id long, text string")
    want = set()
    for i, t in rows:
        text = D.normal(t)
        for item, body in items:
            if text and any(edit_distance_inside(s, text) <= D.budget(len(s)) for _, s in D.segments(D.normal(body))):
                want.add((i, item))
    got = {(r.doc_id, r.item) for r in contaminated(docs, bench).collect()}
    assert len(want) > 15 and got == want
    left = decontaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert contaminated(nothing, bench).count() == contaminated(documents, bench.limit(0)).count() == 0
    assert decontaminated(documents, bench).columns == documents.columns


def test_language_models_tell_domains_apart(spark, documents, nothing, texts):
    rng = random.Random(6)
    # The target uses half of the words that the others use.
    rows = [(i, " ".join(f"{rng.choice('ab') if i % 2 else 'a'}{rng.randrange(30)}" for _ in range(80))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    target = docs.filter("doc_id % 4 = 0 AND doc_id < 200").select("doc_id")
    got = {r.doc_id: r for r in cross_entropy_difference(docs, target).collect()}
    assert all(got[i].score > 0 for i in range(200, 300, 2)) and all(got[i].score < 0 for i in range(201, 300, 2))
    assert got[900].score == got[901].score == got[900].n_words == 0
    assert cross_entropy_difference(nothing, target).count() == 0
    assert cross_entropy_difference(documents, target.limit(0)).count() == len(texts)


def test_language_model_losses(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "A b d")], "doc_id long, text string")
    got = {r.doc_id: r for r in cross_entropy_difference(docs, docs.filter("doc_id = 1").select("doc_id"), size=6).collect()}
    # Words from 2: a, b, c, d. Target bigrams: <s>a, ab, ba, one each.
    single = {w: (n + 1) / (3 + 6) for w, n in {"a": 2, "b": 1, "c": 0}.items()}
    loss = -np.log([0.7 * 1 + 0.3 * single["a"], 0.7 * 1 + 0.3 * single["b"], 0.7 * 1 + 0.3 * single["a"]]).mean()
    assert abs(got[1].target_loss - loss) < 1e-6
    assert abs(got[2].target_loss + np.log([0.7 + 0.3 * single["a"], 0.3 * single["c"]]).mean()) < 1e-6
    assert got[1].score > got[2].score
