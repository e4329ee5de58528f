"""Licence notices, also with small mistakes in them.

A notice of n characters may differ by k = n/10 edits. Cut into k + 1 pieces, at least one piece of it
must then occur exactly (pigeonhole), so an automaton finds all pieces in one pass over the text. Around a found piece, a match with k edits
keeps all but k q of the notice's q-grams; where that many are there, the regular expression library verifies the notice
with at most k errors and gives its span.
"""

from __future__ import annotations

from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pipelinekit.llm.batches import map_slices, utf8

EDITS_PER_CHARACTER = 0.1
GRAM = 4  # characters of a q-gram
# Phrases that name a licence, by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Short notices and the licence they stand for.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "mozilla public license"),
    ("cc", "licensed under cc by"),
    ("cc", "creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl", "eclipse public license"),
    ("cddl", "common development and distribution license"),
    ("bsl", "boost software license version 1 0"),
    ("mit", "spdx license identifier mit"),
    ("apache", "spdx license identifier apache 2 0"),
    ("gpl", "spdx license identifier gpl"),
    ("lgpl", "spdx license identifier lgpl"),
    ("bsd", "spdx license identifier bsd"),
    ("mpl", "spdx license identifier mpl"),
]
# Bytes that are no part of a word: ASCII but digits and letters.
GAPS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, with their places."""
    at = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


def allowed(notice: str) -> int:
    return int(len(notice) * EDITS_PER_CHARACTER)


def places(text: str, phrase: str) -> list[int]:
    """Where a phrase stands in a text whose words are joined by, and enclosed in, single spaces."""
    found, at = [], text.find(f" {phrase} ")
    while at >= 0:
        found.append(at + 1)
        at = text.find(f" {phrase} ", at + 1)
    return found


def scanner(notices: list[tuple[str, str]]):
    """text -> spans (notice number, start, end, edits) in a normalised text."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for number, (_, notice) in enumerate(notices):
        for at, piece in pieces(notice, allowed(notice)):
            seeds.setdefault(piece, []).append((number, at))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    verify = [regex.compile(rf"(?e)\b(?:{regex.escape(notice, literal_spaces=True)}){{e<={allowed(notice)}}}\b") for _, notice in notices]

    grams = [[notice[i : i + GRAM] for i in range(len(notice) - GRAM + 1)] for _, notice in notices]

    def likely(number: int, part: str) -> bool:
        """Whether enough q-grams of a notice are in a part of the text for the notice to be there with all its edits."""
        spare = allowed(notices[number][1]) * GRAM
        for gram in grams[number]:
            if gram not in part:
                spare -= 1
                if spare < 0:
                    return False
        return True

    def regions(text: str) -> dict[int, list[list[int]]]:
        """Per notice, where it may stand; overlapping regions are one."""
        found: dict[int, list[list[int]]] = {}
        for end, (length, uses) in automaton.iter(text):
            for number, at in uses:
                notice = notices[number][1]
                slack = allowed(notice)
                start = max(0, end + 1 - length - at - slack)
                stop = min(len(text), end + 1 - length - at + len(notice) + slack)
                if not likely(number, text[start:stop]):
                    continue
                mine = found.setdefault(number, [])
                if mine and start <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], stop)
                else:
                    mine.append([start, stop])
        return found

    def scan(text: str) -> list[tuple[int, int, int, int]]:
        spans = []
        for number, ranges in sorted(regions(text).items()):
            for start, stop in ranges:
                for m in verify[number].finditer(text, start, stop):
                    spans.append((number, m.start(), m.end(), sum(m.fuzzy_counts)))
        return spans

    return scan


def scan_text(text: bytes | None, scan, notices: list[tuple[str, str]]) -> tuple:
    """The values of ``SCHEMA`` for one text."""
    found = (text or b"").lower().translate(GAPS).split()
    if not found:
        return 0, 0, None, None, "", "", 0.0, []
    line = f" {b' '.join(found).decode()} "
    starts_of, at = [], 1
    for w in found:
        starts_of.append(at)
        at += len(w.decode()) + 1
    word = lambda at: bisect_right(starts_of, at) - 1
    base = {label: [word(at) for at in places(line, phrase)] for label, phrase in PHRASES.items()}
    starts = [at for several in base.values() for at in several]
    base_labels = {label for label, several in base.items() if several}
    spans = [(notices[number][0], word(start), word(end), edits, len(notices[number][1])) for number, start, end, edits in scan(line)]
    labels = base_labels | {s[0] for s in spans}
    score = 1.0 if starts else max((1 - s[3] / s[4] for s in spans), default=0.0)
    return (
        len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
        [{"label": s[0], "first_word": s[1], "last_word": s[2], "edits": s[3]} for s in spans],
    )


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs``: licence phrases, labels, a score and the notices with their spans in words.

    Result: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with an exact phrase, else 1 minus the
    share of edits in the best notice, 0 without one) and notices. Every row gives one row, repeated ones too.
    A null or empty text has no words, no labels and score 0. Texts are scanned whole, in time linear in their length
    but for the regions that are verified, each of them with most of a notice in it. Other columns are not read; an empty table gives no rows.
    """
    notices = NOTICES if notices is None else notices
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kind = docs.select(key).schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        scan = scanner(notices)
        rows = [scan_text(t, scan, notices) for t in utf8(batch.column("text"))]
        return {"key": batch.column("key")} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return map_slices(docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
