"""Joins that compare tables by their keys: keep, drop, moved, pairs, id or name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelinekit.operators.conditions import all_equal, keys_match
from pipelinekit.operators.lookups import lookup


def keep_keys(df: DataFrame, key: str, keys: DataFrame | str | None, prefix: str = "") -> DataFrame:
    """Rows whose key is listed: in the first column of a table, or in comma text.

    Each key of a text gets ``prefix``. No text, or an empty one, keeps every row.
    """
    if isinstance(keys, DataFrame):
        listed = keys.select(F.col(keys.columns[0]).alias("__key")).dropna().distinct()
        return df.join(listed, keys_match([(df[key], listed["__key"])]), "left_semi")
    if not keys:
        return df
    return df.filter(F.col(key).isin([prefix + item for item in keys.split(",")]))


def listed_keys(df: DataFrame, text: str, prefix: str = "", name: str = "key") -> DataFrame:
    """The distinct keys of a column of comma texts, each with ``prefix``."""
    items = df.select(F.explode(F.split(F.col(text), ",")).alias("__item"))
    return items.select(F.concat(F.lit(prefix), "__item").alias(name)).distinct()


def drop_keys(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from the other table; null keys always are."""
    return minus(df, other.dropna(subset=list(on)), on)


def minus(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Like ``drop_keys``, but null keys equal each other."""
    there = other.select(*[F.col(k).alias(f"__{k}") for k in on]).distinct()
    return df.join(there, all_equal(df, there, on), "left_anti")


def all_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The distinct keys of both tables."""
    return left.select(*on).unionByName(right.select(*on)).distinct()


def moved_rows(df: DataFrame, other: DataFrame, key: str, attribute: str) -> DataFrame:
    """Rows the other table lists under the same key with another attribute."""
    value = F.struct(F.col(attribute).alias("value"))
    there = other.dropna(subset=[key]).groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    # Some value differs exactly if the least or the greatest does: one row per key will do.
    same = df[attribute].eqNullSafe(F.col("__low.value")) & df[attribute].eqNullSafe(F.col("__high.value"))
    return df.join(there, keys_match([(df[key], there["__key"])]) & ~same, "left_semi")


def pairs_with(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Each row with each of a short list of literal values.

    The list is part of the plan, so this is a narrow step and not a cross join.
    """
    return df.withColumn(name, F.explode(F.array(*[F.lit(value) for value in values])))


def first_match(df: DataFrame, ref: DataFrame, on, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Add ``cols`` of the first row per key, else nulls."""
    return lookup(df, ref, on, cols, "first", order_by)


def match_id_or_name(
    df: DataFrame,
    ref: DataFrame,
    id_col: str,
    name_col: str,
    ref_id: str,
    ref_name: str,
    order_by: Sequence[str],
    prefix: str = "",
) -> DataFrame:
    """Add the id and name of the reference row with the given id, else with the given name.

    An id without ``prefix`` gets it first. Several rows of one name: the first counts.
    """
    given = F.col(id_col)
    full = F.when(given != "", F.when(given.startswith(prefix), given).otherwise(F.concat(F.lit(prefix), given)))
    by_id = ref.select(F.col(ref_id).alias("__by_id"), F.col(ref_name).alias("__id_name"))
    by_name = ref.filter(F.col(ref_name) != "").select(
        F.col(ref_name).alias("__by_name"), F.col(ref_id).alias("__name_id"), *[F.col(c).alias(f"__{c}") for c in order_by]
    )
    asked = df.withColumn("__full", full)
    found = lookup(
        asked, by_id.withColumn("__same", F.col("__by_id")), {"__full": "__by_id"}, ["__same", "__id_name"], "first", ["__same"]
    )
    found = lookup(found, by_name, {name_col: "__by_name"}, ["__name_id"], "first", [f"__{c}" for c in order_by])
    has_id = F.col("__same").isNotNull()
    return found.select(
        *df.columns,
        F.coalesce("__same", "__name_id").alias("match_id"),
        F.when(has_id, F.col("__id_name")).when(F.col("__name_id").isNotNull(), F.col(name_col)).alias("match_name"),
    )


def with_component(
    df: DataFrame, enabled: Column, place: str, managed: DataFrame, key: str, holders: DataFrame
) -> DataFrame:
    """Rows that are enabled, in a managed place, and whose key some component names."""
    return keep_keys(keep_keys(df.filter(enabled), place, managed), key, holders)
