"""Prepared lookups: a reference reduced and laid out by key once, for any number of lookups.

``lookups.lookup`` reduces and shuffles its reference anew each time. A prepared one is a table of a row per key, with the first
and the last of its rows and their number, in buckets of the key. A lookup reads it where it lies: only the
distinct keys that are asked for move to the buckets, and what they find is attached as by the other lookups, so a frequent
key of the looking-up table costs a row per task there and can be split by Spark here.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelinekit.operators.conditions import keys_match
from pipelinekit.operators.lookups import Keys, _pairs, _total_order
from pipelinekit.storage import scratch_path


@dataclass(frozen=True)
class PreparedLookup:
    """A reference prepared by ``prepare_lookup``; ``close`` removes the table's name, not its files."""

    spark: SparkSession
    table: str
    keys: tuple[str, ...]
    cols: tuple[str, ...]

    def _attach(self, df: DataFrame, on: Mapping[str, str] | None, added: Mapping[str, Column]) -> DataFrame:
        sides = _pairs(on if on is not None else self.keys)
        if set(sides.values()) != set(self.keys):
            raise ValueError(f"the lookup is prepared for keys {', '.join(self.keys)}")
        asked = df.select(*[F.col(left).alias(f"__asked{self.keys.index(right)}") for left, right in sides.items()]).distinct().dropna()
        rows = self.spark.table(self.table)
        at = F.lit(True)
        for i in range(len(self.keys)):
            at = at & (asked[f"__asked{i}"] == rows[f"__key{i}"])
        found = asked.join(rows, at).select(*[f"__asked{i}" for i in range(len(self.keys))], "__first", "__last", "__n")
        same = keys_match((df[left], found[f"__asked{self.keys.index(right)}"]) for left, right in sides.items())
        return df.join(found, same, "left").select(*[df[c] for c in df.columns], *[value.alias(name) for name, value in added.items()])

    def _row(self, df: DataFrame, on: Mapping[str, str] | None, which: str, prefix: str) -> DataFrame:
        return self._attach(df, on, {f"{prefix}{c}": F.col(which).getField(f"v{i}") for i, c in enumerate(self.cols)})

    def first(self, df: DataFrame, on: Mapping[str, str] | None = None, prefix: str = "") -> DataFrame:
        """Add the columns of the first matching row in the prepared order, else nulls."""
        return self._row(df, on, "__first", prefix)

    def last(self, df: DataFrame, on: Mapping[str, str] | None = None, prefix: str = "") -> DataFrame:
        """Add the columns of the last matching row, else nulls."""
        return self._row(df, on, "__last", prefix)

    def match(self, df: DataFrame, on: Mapping[str, str] | None = None, name: str = "matched") -> DataFrame:
        """Add whether any row matches."""
        return self._attach(df, on, {name: F.col("__n").isNotNull()})

    def count(self, df: DataFrame, on: Mapping[str, str] | None = None, name: str = "matches") -> DataFrame:
        """Add the number of matching rows, 0 without any."""
        return self._attach(df, on, {name: F.coalesce("__n", F.lit(0))})

    def every(self, df: DataFrame, on: Mapping[str, str] | None = None) -> DataFrame:
        """Add all of these by one join: ``first_<col>``, ``last_<col>``, ``matched`` and ``matches``."""
        rows = {f"{which}_{c}": F.col(f"__{which}").getField(f"v{i}") for which in ("first", "last") for i, c in enumerate(self.cols)}
        return self._attach(df, on, {**rows, "matched": F.col("__n").isNotNull(), "matches": F.coalesce("__n", F.lit(0))})

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def prepare_lookup(ref: DataFrame, keys: Keys, cols: Sequence[str], order_by: Sequence[str], buckets: int | None = None) -> PreparedLookup:
    """Reduce ``ref`` to a row per key and store it in ``buckets`` (by default as many as there are shuffle partitions).

    Null keys never match; ``order_by`` tells which row of a key is first, the looked-up columns break ties. ``ref`` is read
    and shuffled once, here. The files lie in the shared folder, like all that the library stores.
    """
    if not order_by:
        raise ValueError("a lookup needs order_by to say which row comes first")
    spark, names = ref.sparkSession, list(_pairs(keys).values())
    ranked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(_total_order(ref, cols, order_by))])
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    reduced = ref.dropna(subset=names).groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(names)]).agg(
        F.min_by(values, ranked).alias("__first"), F.max_by(values, ranked).alias("__last"), F.count(F.lit(1)).alias("__n")
    )
    by = [f"__key{i}" for i in range(len(names))]
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"prepared_{uuid.uuid4().hex}"
    # A task per bucket writes one file of it.
    laid = reduced.repartition(count, *by).write.format("parquet").bucketBy(count, *by).sortBy(*by)
    laid.option("path", scratch_path(spark, "prepared")).saveAsTable(table)
    return PreparedLookup(spark, table, tuple(names), tuple(cols))
