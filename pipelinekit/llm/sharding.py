"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are brought into one global order, range partitioned, so a partition is a run of that
order. The totals of the partitions, one row each, are summed up to where every partition begins;
added to the running sum within its partition, that is a row's place in the whole.
Only DataFrame functions are used, and texts are reduced to their sizes before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelinekit.storage import stored

OVERHEAD = 16  # bytes a document takes besides its text


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def byte_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put rows, in order of ``key``, into ``shards`` runs whose bytes are as equal as whole rows allow.

    Result: ``key``, ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless from 0 within a shard, in order). A row goes to the
    shard in whose share of all bytes its middle lies, so shards differ by at most one row's size from their share;
    a row larger than a share leaves a shard empty. Null keys come first; a null text has no bytes. Rows of
    equal keys are ordered by checksum and size, further ties in the order they are read; equal rows are all kept.
    An empty table gives no rows. Other columns are not read.

    Rows are range partitioned by key, checksum, size and place, so that a key with many rows spans partitions.
    """
    sized = docs.select(
        F.col(key).alias("key"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["key", "text_crc32", "size", "place"]
    # Stored twice, narrow: ranges are sampled from what is read once, and must not change between two uses.
    ranged = stored(sized, "sizes").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = stored(ranged, "ranges")

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    begins = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per partition: bounded by the number of partitions.
    summed = ordered.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.count(F.lit(1)).over(within))
    placed = summed.join(F.broadcast(begins), "part").select(
        "key", "size", "text_crc32",
        (F.col("rows_before") + F.col("nth") - 1).alias("at"),
        F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + F.col("upto") - F.col("size") / 2) / F.col("all_bytes") * shards)).cast("int").alias("shard"),
    )
    # As many rows as there are shards.
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")
    )
