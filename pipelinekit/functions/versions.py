"""Semantic versions: a sortable key, the latest version per group, version gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the published grammar of a semantic version, with its groups
# major, minor, patch, pre-release and build. Dotted pre-release items are not empty
# and their numbers have no leading zero.
_ITEM = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    rf"(?:-({_ITEM}(?:\.{_ITEM})*))?"
    r"(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"
)


def version_key(version: Column) -> Column:
    """A struct that compares as semantic versions do; null if unparsable.

    Numbers have no leading zeros, so they compare as their length and then their digits,
    however long they are. A release sorts behind its pre-releases, whose
    items compare one by one, numbers before words. Build metadata has no weight.
    """
    def sized(digits: Column) -> Column:
        return F.struct(F.length(digits).alias("length"), digits.alias("digits"))

    def number(i: int) -> Column:
        return sized(F.regexp_extract(version, SEMVER, i))

    pre = F.regexp_extract(version, SEMVER, 4)
    items = F.transform(
        F.when(pre == "", F.array().cast("array<string>")).otherwise(F.split(pre, r"\.")),
        lambda item: F.struct(
            (~item.rlike(r"^\d+$")).alias("is_word"),
            F.when(item.rlike(r"^\d+$"), sized(item)).alias("number"),
            F.when(~item.rlike(r"^\d+$"), item).alias("word"),
        ),
    )
    key = F.struct(
        number(1).alias("major"),
        number(2).alias("minor"),
        number(3).alias("patch"),
        (pre == "").alias("is_release"),
        items.alias("items"),
    )
    return F.when(version.rlike(SEMVER), key)


def is_later(version: Column, than: Column) -> Column:
    """True if strictly later; false also when either cannot be parsed."""
    return F.coalesce(version_key(version) > version_key(than), F.lit(False))


def latest_version(df: DataFrame, group: Sequence[str], version: str) -> DataFrame:
    """The highest version per group; null if a group has no parsable one.

    Versions that differ in build metadata only are equal; the greatest text is kept.
    """
    key = version_key(F.col(version))
    best = F.max(F.when(key.isNotNull(), F.struct(key.alias("key"), F.col(version).alias("text"))))
    return df.groupBy(*group).agg(best.getField("text").alias(version))


def in_sync(df: DataFrame, group: Sequence[str], version: str, expected: str) -> DataFrame:
    """Per group, whether every ``version`` equals ``expected``; unparsable ones are failures."""
    equal = version_key(F.col(version)) == version_key(F.col(expected))
    return df.groupBy(*group).agg(F.bool_and(F.coalesce(equal, F.lit(False))).alias("in_sync"))


def all_equal(df: DataFrame, group: Sequence[str], version: str) -> DataFrame:
    """Per group, whether all versions are equal; a group with an unparsable one is not. One aggregate, no join."""
    key = version_key(F.col(version))
    equal = (F.min(key) == F.max(key)) & F.bool_and(key.isNotNull())
    return df.groupBy(*group).agg(F.coalesce(equal, F.lit(False)).alias("in_sync"))
