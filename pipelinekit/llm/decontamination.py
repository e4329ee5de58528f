"""Documents that hold passages of a benchmark, up to a budget of edits.

Benchmark items are cut into segments. By the q-gram lemma a segment of m characters that occurs in a document with at most k
edits shares at least m - q + 1 - k q of its q-grams with that place, all of them on diagonals
(document position minus segment position) at most k apart. So shared q-grams are counted in overlapping bands of 2 (k + 1) diagonals,
and the regions of bands that reach the bound are verified by an alignment along their band.

The benchmark is read in blocks of bounded size, and every block is held against all documents: the
documents are never shuffled, only the pairs found are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelinekit.llm.batches import map_slices

Q = 10
SEGMENT = 100  # characters
STEP = 50
EDITS_PER_CHARACTER = 0.08
MIN_CHARACTERS = 24  # shorter items are no passage
BLOCK_CHARACTERS = 4_000_000  # of the benchmark that a task holds at a time
MAP_BITS = 21  # of a table that tells most q-grams of a document to be in no segment
BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all runs of ten characters: of two, four, eight, then ten."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        b2 = BASE * BASE
        b4 = b2 * b2
        two = codes[:-1] * BASE + codes[1:]
        four = two[:-2] * b2 + two[2:]
        eight = four[:-4] * b4 + four[4:]
        return eight[:-2] * b2 + two[8:]


def budget(length: int) -> int:
    """Edits allowed for a segment; at least one shared q-gram must remain."""
    return max(0, min(int(length * EDITS_PER_CHARACTER), (length - Q) // Q))


def bound(length: int) -> int:
    return max(1, length - Q + 1 - budget(length) * Q)


def segments(text: str) -> list[tuple[int, str]]:
    """Overlapping parts of a normalised item with their places; the last one ends with the item."""
    if len(text) < MIN_CHARACTERS:
        return []
    starts = list(range(0, max(1, len(text) - SEGMENT + 1), STEP))
    if starts[-1] + SEGMENT < len(text):
        starts.append(len(text) - SEGMENT)
    return [(at, text[at : at + SEGMENT]) for at in starts]


def mixed(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ (hashes >> np.uint64(29))) * BASE) >> np.uint64(64 - MAP_BITS)


def index(items: list[tuple[int, str]]) -> SimpleNamespace | None:
    """The q-grams of (item id, normalised text) pairs; None if no item is long enough.

    Per segment its item, place, length and padded characters; the sorted distinct hashes; for each of them, from
    ``starts``, the segments (``of``) and places (``at``) that have it; ``seen`` flags leading bits of mixed hashes.
    """
    found = [(item, at, part) for item, text in items for at, part in segments(text)]
    if not found:
        return None
    rows = [characters(part) for _, _, part in found]
    lengths = np.array([len(r) for r in rows])
    codes = np.full((len(rows), SEGMENT), np.uint64(1 << 32))
    for i, r in enumerate(rows):
        codes[i, : len(r)] = r
    all_grams = [grams(r) for r in rows]
    flat = np.concatenate(all_grams)
    of = np.repeat(np.arange(len(rows)), [len(g) for g in all_grams])
    at = np.concatenate([np.arange(len(g)) for g in all_grams])
    order = np.argsort(flat, kind="stable")
    hashes, starts = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << MAP_BITS, bool)
    seen[mixed(hashes)] = True
    return SimpleNamespace(
        items=np.array([f[0] for f in found]), places=np.array([f[1] for f in found]), lengths=lengths, codes=codes,
        hashes=hashes, starts=np.append(starts, len(flat)), of=of[order], at=at[order], seen=seen,
    )


def dense(places: np.ndarray, span: int, least: int) -> np.ndarray:
    """Those of the sorted places that lie in a stretch of ``span`` with at least ``least`` of them."""
    upto = np.searchsorted(places, places + span, "right")
    full = upto - np.arange(len(places)) >= least
    marks = np.zeros(len(places) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(full), 1)
    np.add.at(marks, upto[full], -1)
    return places[np.cumsum(marks[:-1]) > 0]


def candidates(codes: np.ndarray, known: SimpleNamespace) -> np.ndarray:
    """Rows (segment, first diagonal of the band) whose count of shared q-grams reaches the bound."""
    none = np.zeros((0, 2), np.int64)
    hashes = grams(codes)
    at = np.flatnonzero(known.seen[mixed(hashes)])
    if not len(at):
        return none
    which = np.searchsorted(known.hashes, hashes[at])
    which[which == len(known.hashes)] = 0
    at = at[known.hashes[which] == hashes[at]]
    if not len(at):
        return none
    # Whatever the segment, its shared q-grams lie in a stretch of the document not much longer than itself.
    least = min(bound(int(n)) for n in np.unique(known.lengths))
    at = dense(at, SEGMENT + 2 * budget(SEGMENT), least)
    if not len(at):
        return none
    which = np.searchsorted(known.hashes, hashes[at])
    many = known.starts[which + 1] - known.starts[which]
    flat = np.repeat(known.starts[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    segment, diagonal = known.of[flat], np.repeat(at, many) - known.at[flat]
    width = np.array([budget(int(n)) + 1 for n in known.lengths])[segment]
    cell = np.floor_divide(diagonal, width)
    # A band is two neighbouring cells: any diagonals at most k apart lie in one band.
    keys = np.concatenate([segment * (1 << 40) + cell + (1 << 30), segment * (1 << 40) + cell - 1 + (1 << 30)])
    keys, counts = np.unique(keys, return_counts=True)
    segment, cell = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 30)
    bounds = np.array([bound(int(n)) for n in known.lengths])[segment]
    good = counts >= bounds
    width = np.array([budget(int(n)) + 1 for n in known.lengths])[segment]
    return np.column_stack([segment, cell * width])[good]


def aligned(windows: np.ndarray, patterns: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern within the band of its window; where the match starts and ends.

    Row by row over the pattern; column j of row i is window position i + j, so a row has only the
    band's ``width`` columns. All pairs are aligned side by side.
    """
    n = len(windows)
    cost = np.zeros((n, width), np.int32)
    origin = np.tile(np.arange(width, dtype=np.int32), (n, 1))
    for i in range(size):
        step = cost + (windows[:, i : i + width] != patterns[:, i : i + 1])
        start = origin.copy()
        # The pattern's character is left out: from the next column of the row before.
        skip = cost[:, 1:] + 1
        better = skip < step[:, :-1]
        step[:, :-1][better] = skip[better]
        start[:, :-1][better] = origin[:, 1:][better]
        for j in range(1, width):
            # A character of the window is left out: from the column before.
            more = step[:, j - 1] + 1
            better = more < step[:, j]
            step[better, j] = more[better]
            start[better, j] = start[better, j - 1]
        cost, origin = step, start
    best = cost.argmin(axis=1)
    rows = np.arange(n)
    return cost[rows, best], origin[rows, best], size + best


def verified(found: list[tuple[int, np.ndarray, np.ndarray]], known: SimpleNamespace) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, place in the item, start, end, edits) of the candidates within their budget.

    ``found`` has, per row, its characters and its candidates.
    """
    out = []
    pairs = [(row, codes, int(s), int(d)) for row, codes, several in found for s, d in several.tolist()]
    for size in sorted({int(known.lengths[s]) for _, _, s, _ in pairs}):
        mine = [p for p in pairs if known.lengths[p[2]] == size]
        k = budget(size)
        width = 2 * (k + 1) + 2 * k
        for start in range(0, len(mine), 4096):
            part = mine[start : start + 4096]
            windows = np.full((len(part), size + width), np.uint64(1 << 33))
            for i, (_, codes, _, diagonal) in enumerate(part):
                a, b = max(0, diagonal - k), min(len(codes), diagonal - k + size + width)
                windows[i, a - (diagonal - k) : b - (diagonal - k)] = codes[a:b]
            edits, begin, end = aligned(windows, known.codes[[p[2] for p in part], :size], size, width)
            for (row, codes, s, diagonal), e, b, z in zip(part, edits.tolist(), begin.tolist(), end.tolist(), strict=True):
                if e <= k:
                    at = diagonal - k
                    out.append((row, int(known.items[s]), int(known.places[s]), max(0, at + b), min(len(codes), at + z), e))
    return out


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about ``BLOCK_CHARACTERS``, read partition by partition."""
    part, held = [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text)).filter(F.col(item).isNotNull()).toLocalIterator():
        part.append((row[0], normal(row[1])))
        held += len(part[-1][1])
        if held >= BLOCK_CHARACTERS:
            yield part
            part, held = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a segment.

    Result: ``key`` (an integer), ``item``, ``n_segments``, ``edits`` (the least of them), ``start`` and ``end`` of the first and last match in the
    normalised text (lower case, single spaces). Items of fewer than 24 characters and items with a null id are no passages. Null or
    empty texts hold nothing. Rows of one key count as one document, null keys as one too. Texts are searched whole. An empty
    table on either side gives no rows. Other columns are not read.
    """
    packed = docs.selectExpr(f"CAST(`{key}` AS bigint) AS key", f"`{text}` AS text")
    schema = "key long, item long, place long, start long, end long, edits long"

    def searched(known: SimpleNamespace) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batch: pa.RecordBatch) -> dict:
            here, found = shared.value, []
            for row, body in enumerate(batch.column("text").to_pylist()):
                codes = characters(normal(body))
                several = candidates(codes, here)
                if len(several):
                    found.append((row, codes, several))
            rows = verified(found, here)
            keys = batch.column("key").take(pa.array([r[0] for r in rows], pa.int64()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return {"key": keys} | dict(zip(("item", "place", "start", "end", "edits"), columns[1:], strict=True))

        return map_slices(packed, run, schema)

    indexes = [known for known in map(index, blocks(benchmark, item, item_text)) if known]
    if not indexes:
        return docs.sparkSession.createDataFrame([], f"`{key}` long, item long, n_segments long, edits long, start long, end long")
    hits = functools.reduce(DataFrame.unionByName, [searched(known) for known in indexes])
    return hits.groupBy(F.col("key").alias(key), "item").agg(
        F.count_distinct("place").alias("n_segments"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key holds no benchmark passage; rows with a null key are judged as one document."""
    bad = contaminated(docs, benchmark, key, text).select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]), "left_anti")
