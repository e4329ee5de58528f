"""Join conditions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys_match(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Equality of key columns, for a right side reduced to one row per non-null key.

    Spark splits the hot partition of a frequent key only if both sides were shuffled
    for the join itself. A side grouped by the key brings its partitioning along and
    would prevent that. Null-safe equality joins on derived keys, so the reduced side
    is shuffled once more, and the large one can be split. Without null keys on the
    right it means the same as plain equality.
    """
    same = F.lit(True)
    for left, right in pairs:
        same = same & left.eqNullSafe(right)
    return same


def all_equal(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of named columns; the right ones are prefixed with ``__``."""
    return keys_match((left[name], right[f"__{name}"]) for name in names)
