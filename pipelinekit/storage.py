"""Shared scratch folder for tables that cut a lineage and for round-trip files.

The folder is the one the cluster names in ``spark.checkpoint.dir``; where that is unset,
a folder under ``spark.sql.warehouse.dir``, the same rule on every master. Nothing here
removes files: a checkpoint folder is emptied by whoever runs the cluster, and what one piece of
work left there can be told by ``scratch_folder``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # since Spark 4.1; older ones ignore it
_WITHIN: ContextVar[str] = ContextVar("within", default="")


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """All that is stored inside of the block lies below one fresh folder, which is given.

    The caller may delete it as soon as the results that were built inside have been written: until then they read from it.
    """
    outer = _WITHIN.get()
    folder = f"{outer}{name}-{uuid.uuid4().hex}/"
    token = _WITHIN.set(folder)
    try:
        yield f"{shared_dir(spark).rstrip('/')}/{folder.rstrip('/')}"
    finally:
        _WITHIN.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pipelinekit-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{_WITHIN.get()}{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe when executors are lost.

    The shuffle files of the write go with its end. Else they stay until the driver happens to collect its garbage, which many stored tables after one another can't wait for.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
