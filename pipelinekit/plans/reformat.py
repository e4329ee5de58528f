"""Reformat pipeline: config literals glued to names, then a user script."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelinekit.plans.config import ReformatConfig

PASSED_ON = [
    "customer_id",
    "first_name",
    "last_name",
    "phone",
    "email",
    "country_code",
    "account_open_date",
    "account_flags",
]


def reformat(df: DataFrame, config: ReformatConfig = ReformatConfig()) -> DataFrame:
    """``col1`` is both names followed by the string, int and boolean parameters."""
    glued = F.concat(
        F.col("first_name"), F.col("last_name"), F.lit(config.c_string), F.lit(config.c_int), F.lit(config.c_boolean)
    )
    return df.select(glued.alias("col1"), *PASSED_ON)


def reformat_then(
    df: DataFrame,
    config: ReformatConfig = ReformatConfig(),
    script: Callable[[DataFrame], DataFrame] = lambda out: out,
) -> DataFrame:
    """Reformat, then hand the table to a user's script step (by default unchanged)."""
    return df.transform(reformat, config).transform(script)
