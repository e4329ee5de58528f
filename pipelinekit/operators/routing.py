"""Routing rows into valid, invalid and incomplete, with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID, INVALID, INCOMPLETE = "valid", "invalid", "incomplete"


def route(df: DataFrame, rules: Sequence[tuple[str, Column]], incomplete: Column | None = None) -> DataFrame:
    """Add ``status`` and ``reason``; the first failing rule wins.

    Each rule is a reason and the condition that rejects a row for it (null does not).
    ``incomplete`` rows lack what the rules look at and are set apart before them.
    Consumers filter on the status, so the table is classified in one pass.
    """
    status, reason = F, F
    if incomplete is not None:
        status, reason = status.when(incomplete, INCOMPLETE), reason.when(incomplete, "incomplete")
    for text, rejects in rules:
        status, reason = status.when(rejects, INVALID), reason.when(rejects, text)
    if status is F:
        return df.withColumns({"status": F.lit(VALID), "reason": F.lit(None).cast("string")})
    return df.withColumns({"status": status.otherwise(VALID), "reason": reason.otherwise(None)})
