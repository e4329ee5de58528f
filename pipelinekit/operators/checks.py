"""Checks on tables: differences between two, row predicates, metrics of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pipelinekit.functions.nested import quoted
from pipelinekit.operators.running import numbered


def frame_diff(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """The rows in which two tables differ on ``cols``; empty if they agree.

    Without ``keys`` the tables are compared as bags: each differing row with its
    number of ``copies`` and the ``side`` that has them in excess. One aggregation over
    both tables suffices, and repeated rows shrink before they are shuffled.

    With ``keys`` rows are paired by key, and rows of one key in order of the
    compared columns; numbers may differ by ``tolerance``. ``side`` is then ``left`` or
    ``right`` for a row without a partner and ``both`` for a pair that differs, and the
    values of each side are in ``left_<col>`` and ``right_<col>``.
    """
    if keys is None:
        if tolerance:
            raise ValueError("a tolerance needs keys to pair rows by")
        signed = left.select(*cols, F.lit(1).alias("__n")).unionByName(right.select(*cols, F.lit(-1).alias("__n")))
        excess = signed.groupBy(*cols).agg(F.sum("__n").alias("__n")).filter(F.col("__n") != 0)
        side = F.when(F.col("__n") > 0, "left").otherwise("right")
        return excess.select(*cols, side.alias("side"), F.abs("__n").alias("copies"))

    values = [c for c in cols if c not in keys]
    a = numbered(left.select(*keys, *values), keys, values, "__place")
    b = numbered(right.select(*keys, *values), keys, values, "__place")
    a = a.select(*[F.col(c).alias(f"left_{c}") for c in [*keys, *values]], F.col("__place").alias("left_at"))
    b = b.select(*[F.col(c).alias(f"right_{c}") for c in [*keys, *values]], F.col("__place").alias("right_at"))
    same = F.col("left_at") == F.col("right_at")
    for k in keys:
        same = same & F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}"))

    equal = F.lit(True)
    for c in values:
        x, y = F.col(f"left_{c}"), F.col(f"right_{c}")
        close = x.eqNullSafe(y)
        if tolerance and isinstance(left.schema[c].dataType, NumericType):
            close = close | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        equal = equal & close
    side = F.when(F.col("right_at").isNull(), "left").when(F.col("left_at").isNull(), "right").otherwise("both")
    return (
        a.join(b, same, "full_outer")
        .filter(F.col("left_at").isNull() | F.col("right_at").isNull() | ~equal)
        .select(
            *[F.coalesce(f"left_{k}", f"right_{k}").alias(k) for k in keys],
            side.alias("side"),
            *[F.col(f"{s}_{c}") for c in values for s in ("left", "right")],
        )
    )


def assert_same(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] | None = None,
    tolerance: float = 0.0,
    show: int = 10,
) -> None:
    """Fail if two tables differ on ``cols``, showing at most ``show`` differences."""
    found = frame_diff(left, right, cols, keys, tolerance).limit(show).collect()
    if found:
        raise AssertionError("tables differ, among others in:\n" + "\n".join(str(row.asDict()) for row in found))


def row_predicates(df: DataFrame, predicates: Mapping[str, str | Column]) -> DataFrame:
    """One row: for each name, the number of rows its condition does not hold for.

    A condition that is null for a row does not hold for it.
    """
    def failures(condition: str | Column) -> Column:
        holds = F.expr(condition) if isinstance(condition, str) else condition
        return F.count_if(~F.coalesce(holds, F.lit(False)))

    return df.agg(*[failures(condition).alias(name) for name, condition in predicates.items()])


def observed(df: DataFrame, name: str, columns: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """``df`` with its row and null counts observed; read the observation after an action.

    Spark collects the metrics while the table is computed anyway, without a second pass.
    """
    observation = Observation(name)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *nulls), observation


class RunMetrics:
    """Rows and nulls of the nodes of a pipeline, counted by Spark while its one sink is computed.

    ``node`` is put around the table that a node gives, in building the pipeline; after the sink has run, ``table`` has the
    counts. There is no second pass over any node. A node whose rows Spark never needs to compute (the rows that a
    limit leaves out, a branch without a sink) is counted as far as it was computed; of one that Spark has to compute
    again, to sample ranges or after the loss of an executor, rows may be counted more than once.
    """

    def __init__(self) -> None:
        self._nodes: dict[str, tuple[Observation, list[str]]] = {}

    def node(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """``df``, observed as node ``name``; nulls are counted in ``columns``, by default in all."""
        if name in self._nodes:
            raise ValueError(f"there is a node {name} already")
        chosen = list(df.columns if columns is None else columns)
        observation = Observation(f"{name}-{len(self._nodes)}")
        self._nodes[name] = (observation, chosen)
        nulls = [F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(chosen)]
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), *nulls)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per node and column, in the order of the nodes: ``node_index``, ``node``, ``rows``, ``column`` and ``nulls``.

        A node without columns has one row without a column. Waits for the sink if it runs in another thread.
        """
        rows = []
        for index, (name, (observation, columns)) in enumerate(self._nodes.items()):
            found = observation.get
            counts = [(c, found[f"n{i}"]) for i, c in enumerate(columns)] or [(None, None)]
            rows += [(index, name, found["rows"], column, nulls) for column, nulls in counts]
        return spark.createDataFrame(rows, "node_index int, node string, rows long, column string, nulls long")
