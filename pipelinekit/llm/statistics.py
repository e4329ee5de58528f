"""Statistics of whole texts, and the ratios that models of quality read."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pipelinekit.llm.batches import code_points, map_slices, struct, utf8, words

WINDOW = 3  # words in a window of n_repeat_words
# Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = bytes(range(65, 91))
MARKS = b"!?"
DIGITS = b"0123456789"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_marks", "n_digits", "longest_word",
)
SCHEMA = ", ".join(f"{name} long" for name in COUNTS)
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate", "distinct_rate", "longest_word", "log_words")


def repeated_words(found: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    windows = list(zip(*(found[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered = Counter(windows), bytearray(len(found))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + size] = b"\1" * size
    return sum(covered)


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``; a null text has no words."""
    text = text or b""
    found = words(text)
    without = lambda kinds: len(text) - len(text.translate(None, kinds))
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return (
        len(found),
        code_points(text) - without(BLANKS),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(found),
        len(lines),
        len(set(found)),
        without(UPPER),
        without(MARKS),
        without(DIGITS),
        max(map(len, found), default=0),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, packed as ``row``, and the counts as ``stats``.

    Packing keeps columns of the input from clashing with those added.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))

    def count(batch: pa.RecordBatch) -> dict:
        rows = [statistics(text) for text in utf8(batch.column("text"))]
        return {"row": batch.column("row"), "stats": [dict(zip(COUNTS, r, strict=True)) for r in rows]}

    return map_slices(packed, count, StructType([packed.schema["row"], StructField("stats", struct(SCHEMA))]))


def features(stats: str = "stats") -> dict[str, Column]:
    """Ratios of the counts, by name; 0 where a text has nothing to divide by."""
    n = lambda name: F.col(f"{stats}.{name}").cast("double")
    over = lambda a, b: F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0))
    return {
        "word_length": over("word_chars", "n_words"),
        "symbol_rate": over("n_symbols", "word_chars"),
        "dup_line_rate": over("n_dup_lines", "n_lines"),
        "repeat_rate": over("n_repeat_words", "n_words"),
        "upper_rate": over("n_upper", "word_chars"),
        "mark_rate": over("n_marks", "n_words"),
        "digit_rate": over("n_digits", "word_chars"),
        "distinct_rate": over("n_distinct", "n_words"),
        "longest_word": n("longest_word"),
        "log_words": F.log1p(n("n_words")),
    }


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """The ratios and the label of at most ``rows`` labelled documents, chosen by a hash of the key.

    A key with several labels counts as bad (the smallest). The chosen keys are at most ``rows``,
    so they may be broadcast, and only their texts are read for the statistics.
    """
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    chosen = one.orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    return with_statistics(texts).select("row.key", "row.label", "stats", *[c.alias(name) for name, c in features().items()]).limit(rows)
