"""Literal tables for tests: a schema plus rows given for some of its columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pipelinekit.sources.datasets import with_metadata


def fixture_frame(spark: SparkSession, schema: Mapping[str, Any], data: Mapping[str, Any]) -> DataFrame:
    """Rows of ``{"values": [[..], ..], "columns": [..]}`` under a schema document.

    The data may name a subset of the schema's columns, in any order; the others
    are null. Naming a column the schema lacks is an error.
    """
    struct = StructType.fromJson(with_metadata(schema))
    columns = list(data["columns"])
    unknown = [name for name in columns if name not in struct.fieldNames()]
    if unknown:
        raise ValueError(f"columns not in the schema: {unknown}")
    rows = [dict(zip(columns, values, strict=True)) for values in data["values"]]
    return spark.createDataFrame([tuple(row.get(name) for name in struct.fieldNames()) for row in rows], struct)
