"""Python values as columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed_lit(value: Any) -> Column:
    """A literal; lists and tuples become arrays and dicts become maps, at every depth."""
    if isinstance(value, dict):
        return F.create_map(*[typed_lit(item) for entry in value.items() for item in entry])
    if isinstance(value, (list, tuple)):
        return F.array(*[typed_lit(item) for item in value])
    return F.lit(value)
