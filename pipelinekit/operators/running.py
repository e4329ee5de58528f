"""Running values and positions within groups of any size.

The input is evaluated once, into a table in the shared folder (see ``pipelinekit.storage``), when the plan is built. Groups
share buckets by hash, and a count per bucket tells which ones hold more than a task's share of all rows; there are fewer of these than
tasks. Groups elsewhere are smaller than that share, and a window does them in one shuffle. The rows of large buckets are
range partitioned by group and order, so that a large group spans many tasks: each task computes its own part, and
what earlier parts of the same group add is at most one row per partition. Equal rows are told apart by the
place they were read at, so they spread as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pipelinekit.storage import stored

BUCKETS = 16  # for each task


def _bucket(df: DataFrame, by: Sequence[str], buckets: int) -> Column:
    """The bucket of a row's group; 0.0 and -0.0 are one group, and all rows are without ``by``."""
    keys = [F.col(c) + 0.0 if isinstance(df.schema[c].dataType, DoubleType | FloatType) else F.col(c) for c in by]
    return F.pmod(F.xxhash64(*keys, F.lit(0)), F.lit(buckets))


def running(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str | Column],
    value: Column,
    how: str,
    name: str,
    before: bool = False,
) -> DataFrame:
    """Add the running ``sum`` or ``min`` of a value within each group, in order.

    With ``before`` a row's own value does not count; a row with nothing before it has
    null. Rows that ``order_by`` leaves equal come in the order they are read, so it has to order the
    rows of a group totally for a result that repeats when the input is read anew. Null keys form a group.
    """
    merge = {"sum": F.sum, "min": F.min}[how]
    rows = stored(df.withColumn("__value", value).withColumn("__row", F.monotonically_increasing_id()), "rows")
    order = [*order_by, "__row"]
    last = -1 if before else Window.currentRow

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = _bucket(df, by, BUCKETS * tasks)
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    all_rows = F.sum("rows").over(Window.partitionBy())
    # Fewer than there are tasks: each has more than its share.
    large = [row[0] for row in sizes.withColumn("all", all_rows).filter(F.col("rows") * tasks > F.col("all")).select("bucket").collect()]

    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    small = rows.filter(~bucket.isin(large)).select(*df.columns, merge("__value").over(window).alias(name))
    if not large:
        return small

    ordered = rows.filter(bucket.isin(large)).repartitionByRange(*by, *order)
    ordered = ordered.sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    # The partition of a row must not change between the two uses below, not even when
    # an executor is lost, hence the stored table. The upper bits of the id hold it.
    ordered = stored(ordered, "ordered").withColumn("__part", F.shiftright("__at", 33))

    parts = ordered.groupBy(*by, "__part").agg(merge("__value").alias("__part_value"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("__carried", merge("__part_value").over(earlier)).filter(F.col("__carried").isNotNull())
    carried = carried.select(*[F.col(c).alias(f"__key_{c}") for c in by], F.col("__part").alias("__of"), "__carried")

    within = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, last)
    local = ordered.withColumn("__local", merge("__value").over(within))
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    # Only a group that began in an earlier partition has something carried over, and a
    # partition can begin with at most one such group: the table is bounded by their number.
    joined = local.join(F.broadcast(carried), same, "left")
    if how == "sum":
        total = F.coalesce(F.col("__local") + F.col("__carried"), "__local", "__carried")
    else:
        total = F.least("__local", "__carried")
    return small.unionByName(joined.select(*df.columns, total.alias(name)))


def numbered(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in order."""
    return running(df, by, order_by, F.lit(1).cast("long"), "sum", name)


def in_lists(df: DataFrame, by: Sequence[str], item: Column, size: int, name: str = "items") -> DataFrame:
    """Gather numbered rows (``position``) into lists of ``size`` items, divided by position.

    A group continues in ``chunk`` 0, 1, .. so no row grows with its group. A row without a
    position has no item; a group of only such rows has a null list in chunk 0.
    """
    chunk = F.coalesce(F.floor((F.col("position") - 1) / size), F.lit(0)).cast("int")
    entry = F.when(F.col("position").isNotNull(), F.struct("position", item.alias("item")))
    lists = df.groupBy(*by, chunk.alias("chunk")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.getField("item")).alias(name)
    )
    return lists.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
