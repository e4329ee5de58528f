"""Personal data: patterns, and terms that give a person away by what the corpus says.

Four patterns find addresses and numbers; each value found is a protected entity. A term of a document that has an entity
reveals it if seeing the term tells most of the information of seeing the entity: with IC(e) = -log2 p(e) and
PMI(t; e) = log2 p(e | t) / p(e), from counts over all documents, term t discloses entity e if PMI >= DISCLOSURE * IC. The share
p(e | t) is smoothed by one text that has the term without the entity, so that few texts say less than many, and one says
enough only where the entity is rare. Such terms are removed wherever they stand in a document that has the entity.
Terms that are also seen without it, as most words are, have little information about it and stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pipelinekit.llm.batches import map_slices, map_stream
from pipelinekit.operators.conditions import keys_match
from pipelinekit.storage import stored

DISCLOSURE = 0.9
FILTER_BITS = 20  # of a table that spares counting most words that are with no entity
FLUSH = 300_000  # distinct words a task counts before it passes them on

KINDS = ("email", "ip", "card", "phone")
# What removed spans are replaced with.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

# The forms of the base kinds.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
WORD = re.compile(r"[^\W_]+")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Each @ with the name before it and the domain behind it; the same matches as the whole pattern, in linear time."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            last = domain.end()
        else:
            # Nothing before this @ can belong to a later name.
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    return found


def ips(text: str) -> list[Span]:
    """From the start of each run of digits: a later start in a run can match only if the first one does."""
    found, last = [], 0
    if "." not in text:
        return found
    for run in RUN.finditer(text):
        if run.start() < last or not text.startswith(".", run.end()):
            continue
        m = IP.match(text, run.start())
        if m:
            last = m.end()
            # Leading zeros change nothing; a part with over three other digits is too large.
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind in the fixed order, then by start."""
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


def entity(kind: str, text: str) -> str:
    """What is protected: a value without its notation."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else digits_of(text)}"


def number(word: str) -> int:
    """A hash that tells terms, and texts, apart, as a long."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def terms_of(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms of a text with spans: runs of letters and digits outside of them, lower-cased."""
    taken = sorted((start, end) for _, start, end in spans)
    out, at = [], 0
    for m in WORD.finditer(text) if spans else ():
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def found_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, a hash that tells its text, the base spans, and if there are any their values and all terms. Narrow: no texts."""
    kind = docs.select(key).schema[key].dataType.simpleString()
    span, term = "struct<kind:string,start:bigint,end:bigint>", "struct<term:bigint,start:bigint,end:bigint>"

    def run(batch: pa.RecordBatch) -> dict:
        rows = {"body": [], "spans": [], "entities": [], "terms": []}
        for body in batch.column("text").to_pylist():
            body = body or ""
            spans = base_spans(body)
            rows["body"].append(number(body) if spans else None)
            rows["spans"].append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            rows["entities"].append(sorted({entity(k, body[a:b]) for k, a, b in spans}))
            rows["terms"].append([{"term": number(t), "start": a, "end": b} for t, a, b in terms_of(body, spans)])
        return {"key": batch.column("key")} | rows

    packed = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    return map_slices(packed, run, f"key {kind}, body long, spans array<{span}>, entities array<string>, terms array<{term}>")


def cell(terms: np.ndarray) -> np.ndarray:
    return terms >> (64 - FILTER_BITS) & ((1 << FILTER_BITS) - 1)


def document_counts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(term, documents): in how many rows each wanted term stands.

    The wanted terms mark cells of a table of fixed size; words of other cells are not
    counted, and those that share a cell by chance fall out in the join.
    """

    def cells(batch: pa.RecordBatch) -> dict:
        return {"cell": np.unique(cell(batch.column("term").to_numpy()))}

    marked = np.zeros(1 << FILTER_BITS, bool)
    marked[[row[0] for row in map_slices(wanted, cells, "cell long").distinct().collect()]] = True  # at most 2**20 rows
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, passed = Counter(), {}
        for part in parts:
            seen = [w for body in part.column("text").to_pylist() if body for w in {x.lower() for x in set(WORD.findall(body))}]
            new = list({w for w in seen if w not in passed})
            numbers = np.array([number(w) for w in new], np.int64)
            passed.update(zip(new, [n if there else None for n, there in zip(numbers.tolist(), shared.value[cell(numbers)].tolist(), strict=True)], strict=True))
            counts.update(n for w in seen if (n := passed[w]) is not None)
            if len(passed) > FLUSH:
                yield {"word": list(counts), "n": list(counts.values())}
                counts, passed = Counter(), {}
        yield {"word": list(counts), "n": list(counts.values())}

    counted = map_stream(docs.selectExpr(f"`{text}` AS text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("documents"))
    return wanted.join(counted, F.col("term") == F.col("word")).select(F.col("term").alias("counted"), "documents")


def disclosing(found: DataFrame, docs: DataFrame, text: str, threshold: float = DISCLOSURE) -> DataFrame:
    """(body, term) of the terms that reveal an entity of a text, from counts over all documents.

    Copies of one text are evidence once, but count as documents, on either side of each ratio alike. Entities of the same texts
    are one group, which has the same terms: a list of many values costs no more than one of them.
    """
    total = float(max(1, docs.count()))
    having = found.filter(F.col("body").isNotNull())
    marks = having.select("body", F.explode("entities").alias("entity")).groupBy("body", "entity").agg(F.count(F.lit(1)).alias("n"))
    marks = stored(marks, "entities")
    entities = marks.groupBy(F.col("entity").alias("of")).agg(F.bit_xor("body").alias("texts"), F.sum("n").alias("with_entity"))
    groups = marks.join(entities, keys_match([(marks["entity"], entities["of"])])).select(F.col("body").alias("at"), "n", "texts", "with_entity").distinct()
    information = F.log2(F.lit(total) / F.col("with_entity"))
    reach = F.pow(F.lit(2.0), (1 - threshold) * information)  # how many documents with the term there may be to one that has both
    terms = stored(having.select("body", F.explode(F.array_distinct("terms.term")).alias("term")).distinct(), "terms")
    known = document_counts(docs, terms.select("term").distinct(), text)
    counted = terms.join(known, keys_match([(terms["term"], known["counted"])])).select("body", "term", "documents")
    # No more documents have both than have the entity, so terms that are too common for it can go before pairs are counted.
    pairs = counted.join(groups, F.col("body") == F.col("at")).filter((information > 0) & (F.col("documents") <= reach * F.col("with_entity")))
    pairs = stored(pairs.select("body", "term", "documents", "n", "texts", "with_entity"), "pairs")
    joint = pairs.groupBy("texts", "with_entity", "term", "documents").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("evidence"))
    lost = F.col("documents") / F.col("both") + 1 / F.col("evidence")
    revealing = joint.filter(F.log2(lost) <= (1 - threshold) * information)
    revealing = revealing.select(F.col("texts").alias("t"), F.col("with_entity").alias("e"), F.col("term").alias("w"))
    same = keys_match([(pairs["texts"], revealing["t"]), (pairs["with_entity"], revealing["e"]), (pairs["term"], revealing["w"])])
    return pairs.join(revealing, same, "left_semi").select("body", "term").distinct()


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """Per row of ``docs``: its base spans and the spans of terms that reveal what stands in them.

    Result: ``key``, ``body`` (a hash of the text, null without spans), ``spans`` and ``term_spans``, arrays of struct(kind, start, end)
    in code points, the base ones by kind and start. Every row gives one row, repeated ones too; a null or empty
    text has no spans; an empty table gives no rows. Other columns are not read. Terms are flagged only, and
    everywhere, in texts with an entity they reveal, so a text without personal data never changes.
    """
    found = stored(found_spans(docs, key, text), "spans")
    revealing = disclosing(found, docs, text, threshold)
    terms = found.filter(F.col("body").isNotNull()).select("body", F.explode("terms").alias("t")).distinct()
    named = terms.select("body", "t.*")
    met = named.join(revealing.select(F.col("body").alias("b"), F.col("term").alias("w")), (F.col("body") == F.col("b")) & (F.col("term") == F.col("w")), "left_semi")
    # Copies of a text have met in ``distinct``.
    flagged = met.groupBy(F.col("body").alias("of")).agg(
        F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("term_spans")
    )
    joined = found.join(flagged, keys_match([(found["body"], flagged["of"])]), "left")
    none = F.array().cast(flagged.schema["term_spans"].dataType)
    return joined.select(F.col("key").alias(key), "body", "spans", F.coalesce("term_spans", none).alias("term_spans"))


def cut_out(text: str | None, spans: list[Span]) -> str | None:
    """A text with its spans replaced by what they are; where spans overlap, one span from the first start to the last end."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], GENERAL[kind]]
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = DISCLOSURE) -> DataFrame:
    """``docs`` with base spans generalised to their kind and revealing terms removed; rows and columns as before.

    Base spans are found again in each text; revealing terms are looked up by the text's hash, which few texts need.
    """
    found = personal_data(docs, key, text, threshold).filter(F.size("term_spans") > 0)
    terms = found.groupBy(F.col("body").alias("of")).agg(F.first("term_spans").alias("term_spans"))
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))

    def body(batch: pa.RecordBatch) -> dict:
        names = [number(t) if t else None for t in batch.column("text").to_pylist()]
        return {"row": batch.column("row"), "text": batch.column("text"), "body": names}

    def clean(batch: pa.RecordBatch) -> dict:
        out = []
        for t, several in zip(batch.column("text").to_pylist(), batch.column("term_spans").to_pylist(), strict=True):
            out.append(cut_out(t, [*base_spans(t or ""), *[("term", s["start"], s["end"]) for s in several or []]]))
        return {"row": batch.column("row"), "text": out}

    named = map_slices(hashed, body, StructType([*hashed.schema.fields, StructField("body", LongType())]))
    joined = named.join(terms, keys_match([(named["body"], terms["of"])]), "left").select("row", "text", "term_spans")
    done = map_slices(joined, clean, hashed.schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
