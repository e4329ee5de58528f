"""Roll-ups: sets and mappings per group, severities, step status, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from pipelinekit.operators.running import numbered

# Severities, return codes that count as success, and what separates and
# salts the contents of a fingerprint.
ERROR, WARNING = 1, 2
SUCCESS_CODES = (0, 5)
JOINER = "$$$"
SALT = "better_salt_than_never"


def value_sets(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The distinct values of each group and their ``position`` in order, a row for each; nulls are left out."""
    return numbered(df.select(*group, value).filter(F.col(value).isNotNull()).distinct(), group, [value])


def invert(df: DataFrame, parent: str, children: str) -> DataFrame:
    """Turn parent -> array of struct(child, attr) into rows of child, ``position``, parent and attr.

    The parents of a child are numbered in order of parent and attr.
    """
    rows = df.select(F.col(parent).alias("parent"), F.explode(children).alias("c")).select(
        F.col("c.child").alias("child"), "parent", F.col("c.attr").alias("attr")
    )
    return numbered(rows, ["child"], ["parent", "attr"])


def severity_rollup(df: DataFrame, key: Sequence[str], items: str, warnings_as_errors: bool = False) -> DataFrame:
    """Errors, warnings and a broken flag per key, from arrays of struct(severity, ..).

    Items are counted within their row, so nothing is exploded; no items means no faults.
    """
    def found(severity: int) -> Column:
        return F.coalesce(F.size(F.filter(items, lambda item: item.getField("severity") == severity)), F.lit(0))

    counted = df.select(*key, found(ERROR).alias("e"), found(WARNING).alias("w"))
    counted = counted.groupBy(*key).agg(
        F.sum(F.greatest("e", F.lit(0))).alias("num_errors"), F.sum(F.greatest("w", F.lit(0))).alias("num_warnings")
    )
    broken = F.col("num_errors") > 0
    if warnings_as_errors:
        broken = broken | (F.col("num_warnings") > 0)
    return counted.withColumn("is_broken", broken)


def succeeded(code: Column) -> Column:
    """Whether a return code counts as success; no code does not."""
    return F.coalesce(code.isin(*SUCCESS_CODES), F.lit(False))


def step_status(df: DataFrame, step: Sequence[str], failed: Column) -> DataFrame:
    """FAILED for steps with a failed response, else SUCCEEDED; none without responses."""
    any_failed = F.bool_or(F.coalesce(failed, F.lit(False)))
    return df.groupBy(*step).agg(F.when(any_failed, "FAILED").otherwise("SUCCEEDED").alias("status"))


def last_base_path(
    df: DataFrame, key: str, path: str, seq: str, prefixes: Sequence[str], marker: str, name: str = "base_path"
) -> DataFrame:
    """Per key, the latest path under one of the prefixes, cut off at ``marker``."""
    under = F.lit(False)
    for prefix in prefixes:
        under = under | F.col(path).startswith(prefix)
    rows = df.filter(under & F.col(key).isNotNull())
    base = F.split_part(F.col(path), F.lit(marker), F.lit(1))
    return rows.groupBy(key).agg(F.max_by(base, F.struct(seq, path)).alias(name))


def fingerprint(
    df: DataFrame,
    group: Sequence[str],
    name: str,
    content: str,
    salt: str | None = None,
    keep: Column | None = None,
    sep: str = JOINER,
) -> DataFrame:
    """SHA-256, as hex, of a group's contents in order of their names, joined and salted.

    ``keep`` chooses by name; a group of which nothing is kept is that of an empty text.
    Null contents are left out. SHA-256 reads its input from start to end, so a group
    cannot be split over tasks; it is never collected either, but hashed piece by piece
    in sorted order, in memory that does not grow with the group.
    """
    kept = F.col(content) if keep is None else F.when(keep, F.col(content))
    # Rows that add nothing still tell that their group exists; they travel empty.
    rows = df.select(*group, F.when(kept.isNotNull(), F.col(name)).alias("__name"), kept.alias("__content"))
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "__name", "__content")

    schema = StructType([*[df.schema[g] for g in group], StructField("fingerprint", StringType())])
    return ordered.mapInArrow(_digests(len(group), to_arrow_schema(schema), (salt or SALT).encode(), sep), schema)


def _digests(keys: int, schema: pa.Schema, salt: bytes, sep: str):
    # Everything that workers run is nested, so that they need not have the package.
    nan = float("nan")

    def one(value):
        """All NaN are one key: the same object, which equals itself as part of a tuple."""
        return nan if value != value else value

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digest, started = None, None, False

        def closed() -> tuple:
            digest.update(salt)
            return (*open_key, digest.hexdigest())

        for batch in batches:
            finished = []
            group = zip(*([one(v) for v in batch.column(i).to_pylist()] for i in range(keys)), strict=True)
            rows = zip(group, batch.column(keys + 1).to_pylist(), strict=True)
            for key, run in groupby(rows, key=itemgetter(0)):
                if digest is None or key != open_key:
                    if digest is not None:
                        finished.append(closed())
                    open_key, digest, started = key, hashlib.sha256(), False
                texts = [text for _, text in run if text is not None]
                if texts:
                    digest.update(((sep if started else "") + sep.join(texts)).encode())
                    started = True
            yield as_batch(finished)
        if digest is not None:
            yield as_batch([closed()])

    return digests
