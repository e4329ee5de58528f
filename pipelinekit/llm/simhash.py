"""SimHash near-copies: fingerprints, links within a Hamming distance, and their components.

Distances of a fingerprint to reference fingerprints (pivots) are computed once and kept as its row of a
distance table. By the triangle inequality two fingerprints at distance d differ by at most d in every column of that
table, so a pair is thrown out by its largest difference of coordinates, and only survivors are compared bit by bit.
The table alone can't say which pairs to look at (all coordinates of random fingerprints lie close together),
so pairs come from bands: with at most 3 differing bits, one of four 16-bit bands is equal, and among the other
48 bits one of four 12-bit bands. Fingerprints that share one of these 16 keys of 28 bits are the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelinekit.llm.batches import map_slices, map_stream, utf8, words
from pipelinekit.llm.components import components
from pipelinekit.operators.conditions import keys_match
from pipelinekit.storage import stored

SEED = 42
BITS = 64
DISTANCE = 3
PIVOTS = 16  # references of the distance table
CHUNK = 1 << 16  # shingles whose bits are counted at a time


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; 0 without words."""
    found = words(text.lower() if text else text)
    if not found:
        return 0
    if len(found) <= size:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fingerprint) per row of ``docs``, the fingerprint as a long."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "fingerprint": [fingerprint(t, size) for t in utf8(batch.column("text"))]}

    packed = docs.selectExpr(f"CAST(`{key}` AS bigint) AS key", f"`{text}` AS text")
    return map_slices(packed, run, "key long, fingerprint long")


def pivots(number: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the hashes of their numbers."""
    return [int.from_bytes(xxhash.xxh64_digest(str(i).encode(), SEED), "big", signed=True) for i in range(number)]


def distance_table(nodes: DataFrame) -> DataFrame:
    """Add the distances to all pivots, eight of them in the bytes of a long."""

    def packed(group: list[int]) -> Column:
        total = F.lit(0).cast("long")
        for i, pivot in enumerate(group):
            total = total.bitwiseOR(F.shiftleft(F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(pivot))).cast("long"), 8 * i))
        return total

    refs = pivots()
    return nodes.withColumn("near", packed(refs[:8])).withColumn("far", packed(refs[8:]))


def band_keys() -> Column:
    """The 16 keys of a fingerprint: a 16-bit band, a 12-bit band of the remaining bits, and which they are."""

    def bits(value: Column, at: int, length: int) -> Column:
        return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << length) - 1))

    value = F.col("fingerprint")
    keys = []
    for a in range(4):
        low = bits(value, 0, 16 * a) if a else F.lit(0).cast("long")
        high = F.shiftrightunsigned(value, 16 * (a + 1)) if a < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * a).bitwiseOR(low)
        for b in range(4):
            key = F.shiftleft(bits(value, 16 * a, 16), 12).bitwiseOR(bits(rest, 12 * b, 12))
            keys.append(key.bitwiseOR(F.lit((4 * a + b) << 28)))
    return F.array(*keys)


def joined(key: np.ndarray, value: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that connect, within each key, the rows whose fingerprints are near.

    Rows are sorted by key and first coordinate. Each is compared with the next one, the one after it, and so on
    while the key is the same and the first coordinate near enough; a pair adds a link
    only if its rows aren't connected yet, so a key has fewer links than rows.
    """
    root = np.arange(len(key))
    first, second = [], []
    live, step = np.arange(len(key)), 0
    while len(live):
        step += 1
        live = live[live + step < len(key)]
        other = live + step
        still = (key[live] == key[other]) & (table[other, 0].astype(np.int16) - table[live, 0] <= distance)
        live, other = live[still], other[still]
        apart = root[live] != root[other]
        i, j = live[apart], other[apart]
        # Coordinates are at most 64, so their differences fit a signed byte.
        close = (np.abs(table[i].astype(np.int8) - table[j].astype(np.int8)) <= distance).all(axis=1)
        i, j = i[close], j[close]
        same = np.bitwise_count(value[i] ^ value[j]) <= distance
        merged = False
        for x, y in zip(i[same].tolist(), j[same].tolist(), strict=True):
            a, b = x, y
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                first.append(x)
                second.append(y)
                merged = True
        while merged:
            up = root[root]
            merged = not np.array_equal(up, root)
            root = up
    return np.array(first, np.int64), np.array(second, np.int64)


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints -> edges (a, b) that connect all pairs within ``distance`` (at most 3) bits."""
    if distance > 3:
        raise ValueError("the bands find pairs of at most 3 differing bits")
    banded = distance_table(nodes).withColumn("key", F.explode(band_keys()))
    # A byte of ``near`` holds the first coordinate: sorted by it, a row's neighbours are close by.
    dealt = banded.repartition("key").sortWithinPartitions("key", F.col("near").bitwiseAND(F.lit(255)), "fingerprint")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting = np.zeros((0, 4), np.int64)

        def pairs(rows: np.ndarray) -> dict:
            table = np.ascontiguousarray(rows[:, 2:]).view(np.uint8).reshape(len(rows), 16)
            value = np.ascontiguousarray(rows[:, 1])
            i, j = joined(rows[:, 0], value.view(np.uint64), table, distance)
            return {"a": value[i], "b": value[j]}

        for part in parts:
            rows = np.column_stack([part.column(c).to_numpy() for c in ("key", "fingerprint", "near", "far")])
            rows = np.concatenate([waiting, rows])
            # The last key may go on in the next slice.
            whole = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
            waiting = rows[whole:]
            if whole:
                yield pairs(rows[:whole])
        if len(waiting):
            yield pairs(waiting)

    return map_stream(dealt.select("key", "fingerprint", "near", "far"), run, "a long, b long", most=100_000)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs`` its fingerprint and the smallest key it is linked to, directly or over others.

    Result: ``key``, ``fingerprint`` (16 hex digits), ``component_id``. ``key`` is an integer. Rows of equal fingerprints are one node, so thousands
    of copies are compared once. Texts without words, null ones included, have fingerprint zero and link like any
    other. Every row gives one row, repeated ones too; a null key takes no part in the minimum, so the component of
    null keys alone is null. An empty table gives no rows. Other columns are not read.

    Rows that share one 28-bit key are handled in one task; they are distinct fingerprints of 36 free bits.
    """
    rows = stored(fingerprints(docs, key, text, size), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.min("key").alias("least"))
    roots = components(links(nodes.select("fingerprint"), distance))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        nodes["fingerprint"], "least", F.coalesce("root", nodes["fingerprint"]).alias("root")
    )
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    found = rooted.join(smallest, keys_match([(rooted["root"], smallest["of"])])).select(F.col("fingerprint").alias("node"), "component_id")
    # One row per fingerprint against all rows: null-safe, so that a frequent fingerprint can be split.
    return rows.join(found, keys_match([(rows["fingerprint"], found["node"])])).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex(rows["fingerprint"]), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with the smallest key of their group; columns as before.

    Of several rows with that key one stays. Rows with a null key can't be told apart and all stay.
    """
    groups = simhash_components(docs.filter(F.col(key).isNotNull()), key, text, size, distance)
    stays = groups.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__stays")).distinct()
    kept = docs.join(stays, docs[key] == stays["__stays"], "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(key).isNull()))
