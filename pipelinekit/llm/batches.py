"""Arrow batches in, Arrow batches out, in slices of bounded size; words of a text as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_ROWS = 1000
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, most: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most`` rows and, unless it is a single row, ``SLICE_BYTES``."""
    start = 0
    while start < batch.num_rows:
        rows = min(most, batch.num_rows - start)
        while rows > 1 and batch.slice(start, rows).nbytes > SLICE_BYTES:
            rows = (rows + 1) // 2
        yield batch.slice(start, rows)
        start += rows


def arrow(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Lists, numpy or Arrow arrays by column name as a batch."""

    def typed(values, kind: pa.DataType) -> pa.Array:
        if isinstance(values, pa.Array):
            return values if values.type == kind else values.cast(kind)
        return pa.array(values, kind)

    return pa.RecordBatch.from_arrays([typed(columns[f.name], f.type) for f in schema], schema=schema)


def struct(columns: str | StructType) -> StructType:
    return StructType.fromDDL(columns) if isinstance(columns, str) else columns


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """``function`` over slices of the rows; it returns columns, of any number of rows."""
    kind = struct(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield arrow(function(part), target)

    return df.mapInArrow(run, kind)


def map_stream(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType, most: int = SLICE_ROWS
) -> DataFrame:
    """``function`` over the stream of a partition's slices, for what is carried from slice to slice."""
    kind = struct(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(part for batch in batches for part in slices(batch, most)):
            yield arrow(columns, target)

    return df.mapInArrow(run, kind)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: bytes split at ASCII white space only."""
    return text.split() if text else []


def code_points(text: bytes) -> int:
    """Code points of UTF-8: all bytes but continuation bytes."""
    return len(text.translate(None, bytes(range(0x80, 0xC0))))
