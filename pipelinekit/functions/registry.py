"""Registration hook: the text helpers as SQL functions of the caller's session, made from the helpers themselves."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pipelinekit.functions import text

# Each function with its arguments and their types; what it returns follows from its body.
FUNCTIONS: Mapping[Callable[..., Column], Mapping[str, str]] = {
    text.short_hash: {"text": "STRING"},
    text.normalise_name: {"name": "STRING"},
    text.strip_prefix: {"text": "STRING", "prefix": "STRING"},
    text.is_blank: {"text": "STRING"},
    text.jar_version: {"path": "STRING"},
    text.package_parts: {"path": "STRING"},
    text.reference_fields: {"text": "STRING"},
    text.bucket_of: {"path": "STRING", "scheme": "STRING"},
    text.prefix_of: {"path": "STRING", "scheme": "STRING"},
    text.part_behind: {"path": "STRING", "marker": "STRING", "n": "INT"},
}


def register_functions(spark: SparkSession, functions: Mapping[Callable[..., Column], Mapping[str, str]] = FUNCTIONS) -> list[str]:
    """Make functions of columns callable from SQL text, under their own names; returns these.

    Called before a run. A function is applied to columns named like its arguments, and what Spark resolves that to becomes the body, which Catalyst
    inlines where it is called: nothing runs in Python. It must be made of functions that SQL has, without
    lambdas. There are no aggregate functions of our own to register: the built-in ones cover everything the library computes.
    """
    names = []
    for function, arguments in functions.items():
        name, declared = function.__name__, ", ".join(f"{argument} {kind}" for argument, kind in arguments.items())
        resolved = spark.createDataFrame([], declared).select(function(*map(F.col, arguments)).alias("result"))
        body = resolved._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {resolved.schema['result'].dataType.simpleString()} RETURN {body}")
        names.append(name)
    return names
