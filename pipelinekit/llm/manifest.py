"""A Merkle tree over the rows of a table: one tree per group, their roots once more in a tree.

A tree is built in tiers of ``LEVELS`` levels. The rows of a tier are cut into chunks of ``FANOUT ** LEVELS`` positions, each a
window partition of its own, so a group with most of the rows spreads over as many tasks as it has chunks. Within a chunk every level
reads its siblings by lag and lead at fixed offsets (a node of level l lies on the row of its first leaf, its
siblings ``FANOUT ** l`` rows on), masked by the slot of the node in its run; the first child of a run hashes the parent.
What a chunk comes to is a row of the next tier. Proofs go the other way: a chunk's row meets its own path from
above on (tree, chunk), and texts are reduced to digests before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelinekit.operators.running import numbered
from pipelinekit.storage import stored

FANOUT = 8
LEVELS = 4
CHUNK = FANOUT**LEVELS  # rows of a window partition
PATH = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    """SHA-256 as lowercase hex."""
    return F.sha2(value, 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value ``-`` if null, else its UTF-8 bytes, ``:`` and the value as text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(part, values)))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. A text of ASCII only has no other letters, and ``lower`` is the faster way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def folded(start: Column, path: str) -> Column:
    """The root that a digest leads to along a path of siblings."""
    return F.aggregate(path, start, lambda node, level: digest(F.concat(level["left"], node, level["right"])))


def siblings(path: str) -> Column:
    """The digests of a path, level by level from the left to the right, as one text."""
    return F.concat_ws("", F.transform(path, lambda level: F.concat(level["left"], level["right"])))


def _climbed(nodes: DataFrame) -> DataFrame:
    """Nodes (``__tree``, ``__at`` from 0, ``__digest``) with their chunk, their path within it and, on its first row, what it comes to."""
    spread = nodes.withColumn("__chunk", F.floor(F.col("__at") / CHUNK))
    within = Window.partitionBy("__tree", "__chunk").orderBy("__at")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    node = F.col("__digest")
    for level in range(LEVELS):
        step = FANOUT**level
        first = F.col("__at") % step == 0
        slot = F.floor(F.col("__at") / step) % FANOUT
        before = [F.when(slot >= k, F.lag(node, k * step).over(within)) for k in range(FANOUT - 1, 0, -1)]
        after = [F.when(slot + k < FANOUT, F.lead(node, k * step).over(within)) for k in range(1, FANOUT)]
        # The only node of its tree is not hashed again.
        alone = (F.col("__at") == 0) & F.lead(node, step).over(within).isNull()
        spread = spread.withColumns({
            f"__left{level}": F.when(first & ~alone, F.concat_ws("", *before)),
            f"__right{level}": F.when(first & ~alone, F.concat_ws("", *after)),
            f"__alone{level}": alone,
        })
        parent = F.when(F.col(f"__alone{level}"), node).otherwise(digest(F.concat(node, F.col(f"__right{level}"))))
        spread = spread.withColumn(f"__node{level + 1}", F.when(first & (slot == 0), parent))
        node = F.col(f"__node{level + 1}")
    # The siblings of an ancestor stand on its first leaf, the last row before with any.
    levels = [
        F.struct(*[F.last(f"__{side}{level}", ignorenulls=True).over(upto).alias(side) for side in ("left", "right")]) for level in range(LEVELS)
    ]
    path = F.filter(F.array(*levels), lambda level: level["left"].isNotNull())
    return spread.select(*nodes.columns, "__chunk", path.cast(PATH).alias("__path"), node.alias("__top"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, what their chunks come to, and so on until each tree is one row."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("__at")).first()[0] or 0) > 0:
        tops = _climbed(tiers[-1]).filter(F.col("__top").isNotNull() & (F.col("__at") % CHUNK == 0))
        tiers.append(stored(tops.select("__tree", F.col("__chunk").alias("__at"), F.col("__top").alias("__digest")), "nodes"))
    return tiers


def _descended(tiers: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first tier with their whole ``__path`` and the columns of ``above``, a row per tree with its path from there."""
    found = above.withColumn("__at", F.lit(0).cast("long"))
    for tier in reversed(tiers[:-1]):
        upper = found.select(
            F.col("__tree").alias("__up_tree"), F.col("__at").alias("__up_at"), F.col("__path").alias("__up_path"),
            *[c for c in above.columns if c not in ("__tree", "__path")],
        )
        lower = _climbed(tier)
        joined = lower.join(upper, (lower["__tree"] == upper["__up_tree"]) & (lower["__chunk"] == upper["__up_at"]))
        found = joined.withColumn("__path", F.concat("__path", "__up_path")).drop("__chunk", "__top", "__up_tree", "__up_at", "__up_path")
    if len(tiers) == 1:
        found = tiers[0].join(found.drop("__at"), "__tree")
    return found


def merkle_proofs(leaves: DataFrame, by: str, order_by: Sequence[str], leaf: str = "leaf") -> DataFrame:
    """Add ``subroot``, ``root`` and ``path`` to rows that have their digest in column ``leaf``.

    The rows of a group ``by`` are leaves in the order of ``order_by``, ties by digest (rows equal in all of these are
    interchangeable, and each is a leaf). While a group has several nodes, every eight consecutive ones become their
    parent; what remains is its ``subroot``. The subroots, by group (null first, then by UTF-8 bytes), likewise give the ``root``. ``path``
    lists the siblings of a leaf up to the root, per level with more than one node what lies left and right of its
    ancestor (empty where nothing does): ``folded`` leads along it. Nulls in ``order_by`` come first, a null
    group is a group. All columns are kept (names beginning with two underscores, ``subroot``, ``root`` and ``path`` are taken). An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    rows = stored(leaves.withColumn("__tree", tree).withColumn("__digest", F.col(leaf)), "leaves")
    placed = numbered(rows, ["__tree"], [*order_by, "__digest"], "__position")
    nodes = stored(placed.withColumn("__at", F.col("__position") - 1).drop("__position"), "nodes")
    tiers = _tiers(nodes)

    roots = tiers[-1].select(F.col("__tree").alias("__child"), F.col("__digest"), F.lit("").alias("__tree"))
    roots = numbered(roots, ["__tree"], ["__child"], "__position").withColumn("__at", F.col("__position") - 1).drop("__position")
    root_tiers = _tiers(stored(roots, "subroots"))
    top = root_tiers[-1].select("__tree", F.array().cast(PATH).alias("__path"), F.col("__digest").alias("root"))
    ends = _descended(root_tiers, top).select(F.col("__child").alias("__tree"), "__path", F.col("__digest").alias("subroot"), "root")
    found = _descended(tiers, ends)
    return found.select(*leaves.columns, "subroot", "root", F.col("__path").alias("path"))
