"""Connected components of any size by alternating stars, on stored tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelinekit.operators.conditions import keys_match
from pipelinekit.storage import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang every node's neighbours (the larger ones, or the others) on the smallest of them.

    Edges are a > b. The smallest neighbour is an aggregate, joined back on null-safe keys
    so that the edges of a node with very many neighbours can be split.
    """
    if larger:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).withColumn("least", F.least("node", "least"))
    met = near.join(least, keys_match([(near["a"], least["node"])]))
    if larger:
        moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).union(met.select("a", F.col("least").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root), root being the smallest node reached.

    Nodes without an edge to another node are left out. Repeated edges, loops and either direction are fine;
    edges with a null end are dropped. An empty table gives no rows. Every round writes its edges to the
    shared folder, so lost executors cost one round at most. The rounds end when one changes nothing; a path of n nodes needs about log n.
    """
    clean = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(clean, "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        now = stored(_stars(_stars(now, True), False), "edges")
