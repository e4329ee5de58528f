"""Datasets described by a spec: format, path, options, schema and write mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The keys of a dataset document that are not Spark options.
NOT_OPTIONS = {
    "format",
    "path",
    "schema",
    "useSchema",
    "writeMode",
    "partitionColumns",
    "datasetType",
    "description",
}

# Document keys whose Spark option has another name. The two blank
# trimming options exist once per direction in a document and once in Spark.
READ_NAMES = {
    "separator": "sep",
    "ignoreLeadingWhiteSpaceReading": "ignoreLeadingWhiteSpace",
    "ignoreTrailingWhiteSpaceReading": "ignoreTrailingWhiteSpace",
}
WRITE_NAMES = {
    "separator": "sep",
    "ignoreLeadingWhiteSpaceWriting": "ignoreLeadingWhiteSpace",
    "ignoreTrailingWhiteSpaceWriting": "ignoreTrailingWhiteSpace",
}

# Options that only make sense when reading; a writer must not be handed them.
READ_ONLY = {
    "inferSchema",
    "enforceSchema",
    "mode",
    "columnNameOfCorruptRecord",
    "samplingRatio",
    "recursiveFileLookup",
    "pathGlobFilter",
    "modifiedBefore",
    "modifiedAfter",
    "mergeSchema",
}


@dataclass(frozen=True)
class DatasetSpec:
    """A named dataset. ``None`` options are unset, so Spark's defaults apply."""

    format: str
    path: str
    options: Mapping[str, Any] = field(default_factory=dict)
    schema: StructType | str | None = None
    write_mode: str | None = None
    partition_by: Sequence[str] = ()

    @classmethod
    def from_document(cls, document: Mapping[str, Any]) -> DatasetSpec:
        """Build a spec from a dataset document (a parsed JSON or YAML mapping).

        The schema is used only when the document says so with ``useSchema``.
        """
        schema = document.get("schema")
        return cls(
            format=document["format"],
            path=document["path"],
            options={k: v for k, v in document.items() if k not in NOT_OPTIONS},
            schema=StructType.fromJson(with_metadata(schema)) if schema and document.get("useSchema") else None,
            write_mode=document.get("writeMode"),
            partition_by=tuple(document.get("partitionColumns") or ()),
        )

    def at(self, path: str) -> DatasetSpec:
        """The same dataset stored somewhere else."""
        return replace(self, path=path)

    def read_options(self) -> dict[str, Any]:
        return _renamed(self.options, READ_NAMES, WRITE_NAMES)

    def write_options(self) -> dict[str, Any]:
        kept = {k: v for k, v in self.options.items() if k not in READ_ONLY}
        return _renamed(kept, WRITE_NAMES, READ_NAMES)


def _renamed(options: Mapping[str, Any], names: Mapping[str, str], other: Mapping[str, str]) -> dict[str, Any]:
    return {
        names.get(key, key): value
        for key, value in options.items()
        if value is not None and (key in names or key not in other)
    }


def with_metadata(schema: Any) -> Any:
    """Fill in what a hand-kept schema document may leave out of its fields."""
    if isinstance(schema, Mapping):
        filled = {key: with_metadata(value) for key, value in schema.items()}
        if "name" in filled and "type" in filled:
            filled = {"nullable": True, "metadata": {}, **filled}
        return filled
    if isinstance(schema, list):
        return [with_metadata(item) for item in schema]
    return schema


def read(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Read a dataset.

    A CSV read with fewer columns than the file keeps the first ones, which relies
    on Spark's default ``PERMISSIVE`` parse mode.
    """
    reader = spark.read.format(spec.format).options(**spec.read_options())
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    return reader.load(spec.path)


def write(df: DataFrame, spec: DatasetSpec) -> None:
    """Write ``df``. Without a write mode an existing path is an error.

    A sorted frame keeps its order: part files are numbered in sort order.
    """
    writer = df.write.format(spec.format).options(**spec.write_options())
    if spec.write_mode is not None:
        writer = writer.mode(spec.write_mode)
    if spec.partition_by:
        writer = writer.partitionBy(*spec.partition_by)
    writer.save(spec.path)
