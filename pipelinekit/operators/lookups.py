"""Key and range lookups, built as joins so that both sides scale.

A key matches on equality of all key columns; null keys never match. Rows have no
order of their own, so first, last, n-th and all rows need ``order_by`` (columns,
ascending, nulls first); the looked-up columns break ties. Every lookup leaves the
looking-up table's rows and their number unchanged, except ``lookup_rows``, which has
a row per distinct key, and ``range_lookup`` over overlapping ranges.

The reference table is reduced to one row per key before the join, with map-side
aggregation, so a key holding much of it costs no more than others; n-th and all rows are
numbered with a key spread over many tasks. A frequent key of the looking-up table is left to Spark's splitting of skewed join partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from pipelinekit.operators.conditions import keys_match
from pipelinekit.operators.running import numbered

Keys = Sequence[str] | Mapping[str, str]


def _pairs(on: Keys) -> dict[str, str]:
    """Key columns of the looking-up table and their names in the reference table."""
    return dict(on) if isinstance(on, Mapping) else {name: name for name in on}


def _usable(ref: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    return ref.dropna(subset=list(keys.values()))


def _sortable(kind: DataType) -> bool:
    """Whether Spark can order values of this type: not where a map or a variant is part of it."""
    if isinstance(kind, ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_sortable(field.dataType) for field in kind)
    return not isinstance(kind, MapType | VariantType)


def _total_order(ref: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> list[str]:
    """The order columns, then the looked-up ones as far as they can be ordered."""
    return [*order_by, *[c for c in cols if c not in order_by and _sortable(ref.schema[c].dataType)]]


def _attach(df: DataFrame, found: DataFrame, keys: Mapping[str, str], *added: Column) -> DataFrame:
    """Left join of one row per key; ``found`` names its keys ``__key_<name>``."""
    same = keys_match((df[left], found[f"__key_{right}"]) for left, right in keys.items())
    return df.join(found, same, "left").select(*[df[name] for name in df.columns], *added)


def _keyed(ref: DataFrame, keys: Mapping[str, str]) -> list[Column]:
    return [ref[name].alias(f"__key_{name}") for name in keys.values()]


def lookup(
    df: DataFrame,
    ref: DataFrame,
    on: Keys,
    cols: Sequence[str],
    which: str = "first",
    order_by: Sequence[str] = (),
    n: int | None = None,
) -> DataFrame:
    """Add ``cols`` of the ``first``, ``last`` or ``nth`` (from 1) matching row, else nulls.

    Columns that hold maps can be looked up, but cannot break ties.
    """
    if not order_by:
        raise ValueError("a lookup needs order_by to say which row comes first")
    keys = _pairs(on)
    usable = _usable(ref, keys)
    order = _total_order(ref, cols, order_by)
    if which in ("first", "last"):
        pick = F.min_by if which == "first" else F.max_by
        # Plain field names of their own: order columns and looked-up columns may coincide.
        ranked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
        found = usable.groupBy(*_keyed(usable, keys)).agg(pick(values, ranked).alias("__row"))
        added = [F.col(f"__row.v{i}").alias(c) for i, c in enumerate(cols)]
        return _attach(df, found, keys, *added)
    if which != "nth" or n is None or n < 1:
        raise ValueError("which must be 'first', 'last', or 'nth' with n of at least 1")
    by = list(keys.values())
    chosen = numbered(usable.select(*dict.fromkeys([*by, *order, *cols])), by, order, "__place").filter(F.col("__place") == n)
    found = chosen.select(*_keyed(chosen, keys), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)])
    return _attach(df, found, keys, *[F.col(f"__v{i}").alias(c) for i, c in enumerate(cols)])


def lookup_match(df: DataFrame, ref: DataFrame, on: Keys, name: str = "matched") -> DataFrame:
    """Add whether any row matches."""
    keys = _pairs(on)
    usable = _usable(ref, keys)
    found = usable.select(*_keyed(usable, keys)).distinct().withColumn("__found", F.lit(True))
    return _attach(df, found, keys, F.coalesce("__found", F.lit(False)).alias(name))


def lookup_count(df: DataFrame, ref: DataFrame, on: Keys, name: str = "matches") -> DataFrame:
    """Add the number of matching rows, 0 without any."""
    keys = _pairs(on)
    usable = _usable(ref, keys)
    found = usable.groupBy(*_keyed(usable, keys)).agg(F.count(F.lit(1)).alias("__n"))
    return _attach(df, found, keys, F.coalesce("__n", F.lit(0)).alias(name))


def lookup_rows(
    df: DataFrame, ref: DataFrame, on: Keys, cols: Sequence[str], order_by: Sequence[str], reverse: bool = False
) -> DataFrame:
    """All matching rows, in order or reversed, once per distinct key of ``df``.

    Result: key columns, ``position`` from 1 and ``cols``, a row for each match; keys without
    a match have one row with nulls. Repeating the matches for every row of ``df`` would pair
    all rows of a frequent key, so that join is left to the caller, and so is gathering
    rows into lists (``running.in_lists``), as a key may have any number of matches.
    """
    keys = _pairs(on)
    asked = df.select(*keys).distinct()
    wanted = asked.dropna()
    usable = _usable(ref, keys)
    same = keys_match((usable[right], wanted[left]) for left, right in keys.items())
    order = _total_order(ref, cols, order_by)
    matches = usable.join(wanted, same, "left_semi").select(
        *[F.col(right).alias(f"__key_{right}") for right in keys.values()],
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
        *[F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)],
    )
    ordering = [F.col(f"__o{i}").desc() if reverse else F.col(f"__o{i}").asc() for i in range(len(order))]
    placed = numbered(matches, [f"__key_{right}" for right in keys.values()], ordering)
    matched = placed.select(
        *[F.col(f"__key_{right}").alias(left) for left, right in keys.items()],
        "position", *[F.col(f"__v{i}").alias(c) for i, c in enumerate(cols)],
    )
    # Keys without a match are added, not joined: a join would gather a key's matches.
    there = usable.select(*_keyed(usable, keys)).distinct()
    met = keys_match((asked[left], there[f"__key_{right}"]) for left, right in keys.items())
    nothing = [F.lit(None).cast(ref.schema[c].dataType).alias(c) for c in cols]
    unmatched = asked.join(there, met, "left_anti").select(*keys, F.lit(None).cast("long").alias("position"), *nothing)
    return matched.unionByName(unmatched)


def range_lookup(df: DataFrame, ref: DataFrame, value: str, lo: str, hi: str, cols: Sequence[str]) -> DataFrame:
    """Add ``cols`` of the ranges with ``lo <= value < hi``; nulls without one.

    Ranges that do not overlap give one row per row of ``df``; of overlapping ranges
    each gives a row. Ends may be infinite; a range with a null end matches nothing. All ends cut the line into segments, numbered
    in order; a range is a run of segments, split into the nodes of a binary tree over them, two per level at most. A
    value finds its segment by the last cut before it, and the segments with any value meet the ranges on their nodes. So neither side
    is compared with more than it matches, however ranges nest. It is one plan, evaluated when the result is.
    """
    ranges = ref.filter(F.col(lo) < F.col(hi)).select(
        F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)]
    )
    names = [f"__v{i}" for i in range(len(cols))]
    cuts, placed = _ranked_cuts(ranges.select(F.explode(F.array("__lo", "__hi")).alias("__point")).distinct())
    ends = cuts.select(F.col("__point").alias("__end"), F.col("__rank").alias("__j"), "__levels")
    lows = cuts.select(F.col("__point").alias("__low"), F.col("__rank").alias("__i"))
    runs = ranges.join(lows, ranges["__lo"] == lows["__low"]).join(ends, ranges["__hi"] == ends["__end"])

    # On each level a run not yet covered gives away what isn't the first, or isn't the second, of a pair.
    at_level = runs.withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__levels"))))
    first, end = F.expr("shiftright(__i + shiftleft(1L, __level) - 1, __level)"), F.expr("shiftright(__j, __level)")
    given = F.array(F.when((first < end) & (first % 2 == 1), first), F.when((first < end) & (end % 2 == 1), end - 1))
    nodes = at_level.withColumn("__node", F.explode(F.array_compact(given))).select("__level", "__node", *names)

    rows = placed(df.select(F.struct(*df.columns).alias("__row"), F.col(value).alias("__point")))
    met = rows.select("__rank", "__levels").dropna().distinct().withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__levels"))))
    met = met.select(F.col("__rank").alias("__of"), "__level", F.expr("shiftright(__rank, __level)").alias("__node"))
    found = met.join(nodes, ["__level", "__node"]).select("__of", *names)
    # A segment may hold any share of the rows: Spark can split this join.
    joined = rows.join(found, keys_match([(rows["__rank"], found["__of"])]), "left")
    return joined.select(*[F.col("__row").getField(c).alias(c) for c in df.columns], *[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)])


def _ranked_cuts(cuts: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Distinct cuts (``__point``) with their ``__rank`` from 1 and the ``__levels`` of a tree over the ranks, and what ranks other rows.

    The line is parted at quantiles of the cuts, taken from a sketch of bounded size, so that each part is a window partition of
    its own; what the cuts of earlier parts add is one number per part. Other rows (``__row``, ``__point``) get
    the rank of the last cut not above their point, 0 before the first, null for a null. As they may all lie in one part, each part is
    divided once more by a hash of the rows, with its cuts in each division.
    """
    spark = cuts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    divisions = math.isqrt(tasks - 1) + 1 if tasks > 1 else 1
    parts = -(-tasks // divisions)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = cuts.agg(F.percentile_approx(F.col("__point").cast("double"), shares, 100 * parts)).scalar()

    def parted(some: DataFrame) -> DataFrame:
        part = F.greatest(F.size(F.filter("__bounds", lambda b: b < F.col("__point").cast("double"))), F.lit(0)).cast("long")
        return some.withColumn("__bounds", bounds).withColumn("__part", part).drop("__bounds")

    # How many cuts lie in the parts before each part, and the levels: a fixed number of values.
    entries = parted(cuts).groupBy("__part").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("__part", "n")).alias("parts"))
    summed = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda total, e: total + e.getField("n"))
    every = F.sequence(F.lit(0), F.lit(len(shares)))
    before = F.transform(every, lambda p: summed(F.filter("parts", lambda e: e.getField("__part") < p)))
    levels = F.ceil(F.log2(summed(F.col("parts")) + 1)).cast("int")
    carried = entries.select(F.struct(before.alias("before"), levels.alias("levels")).alias("carried")).scalar()
    so_far = F.element_at(carried.getField("before"), F.col("__part").cast("int") + 1)
    levels = carried.getField("levels").alias("__levels")

    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__point"))
    local = parted(cuts).withColumn("__nth", nth)

    def placed(rows: DataFrame) -> DataFrame:
        hashed = F.xxhash64(*[F.col("__row").getField(f.name) for f in rows.schema["__row"].dataType if _sortable(f.dataType)])
        spread = parted(rows).withColumn("__division", F.pmod(hashed, F.lit(divisions)))
        lines = local.select(
            F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__point", "__part",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(divisions - 1).cast("long"))).alias("__division"), "__nth",
        )
        both = spread.withColumn("__nth", F.lit(None).cast("int")).unionByName(lines)
        before = Window.partitionBy("__part", "__division").orderBy("__point", F.col("__nth").desc_nulls_last())
        last = F.last("__nth", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = both.withColumn("__last", F.coalesce(last, F.lit(0))).filter(F.col("__row").isNotNull())
        return ranked.select("__row", F.when(F.col("__point").isNotNull(), F.col("__last") + so_far).alias("__rank"), levels)

    return local.select("__point", (F.col("__nth") + so_far).alias("__rank"), levels), placed
