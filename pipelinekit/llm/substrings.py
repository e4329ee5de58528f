"""Removal of word passages that an earlier document already has.

The Rabin-Karp hash of every window of 13 words is computed as a polynomial over word hashes. A slab of documents sorts its
windows by hash and keeps, per distinct hash, the smallest document that has it: what repeats inside the
slab is settled there, and a passage that a third of all documents share costs one entry per slab. The entries
go, in packed runs, to the bucket of their hash, where the smallest document of all slabs is found. Every
(document, hash) that has an earlier document goes back, with others of its team of documents, to its document, where the covered words of overlapping windows merge into
maximal intervals, which are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pipelinekit.llm.batches import arrow, map_slices, map_stream, utf8, words
from pipelinekit.operators.conditions import keys_match

WINDOW = 13
SLAB = 1_500_000  # windows that a task sorts at a time
BUCKETS_PER_PARTITION = 2
BASE = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier, so that no word of a window is lost


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values modulo 2**64, by doubling: about 2 log(size) passes."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        done, result, power, span, shift = 0, None, values, 1, BASE
        while True:
            if size & span:
                if result is None:
                    result, done = power, span
                else:
                    n = len(values) - done - span + 1
                    result = result[:n] * shift + power[done : done + n]
                    done += span
            if done == size:
                return result
            n = len(power) - span
            power = power[:n] * shift + power[span : span + n]
            shift, span = shift * shift, span * 2


def window_hashes(found: list[bytes], size: int = WINDOW) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return rolling(np.fromiter((digest(w) for w in found), np.uint64, len(found)), size)


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, each place a block of its own: high bytes are few and take few bits, which Spark's codec doesn't see."""
    packer = zstandard.ZstdCompressor(level=1).compressobj()
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    blocks = [packer.compress(row.tobytes()) + packer.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) for row in rows]
    return b"".join([*blocks, packer.flush()])


def unplaned(data: bytes) -> np.ndarray:
    whole = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def steps(values: np.ndarray) -> bytes:
    """Sorted numbers as their first one and the steps between them, which have few high bytes."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that rise with the hash: sorted hashes lie in runs of one bucket."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def least_per_hash(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with their smallest document, and all (hash, document) that have a smaller one."""
    order = np.argsort(hashes)
    h, d = hashes[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(d, starts) if len(h) else d
    later = d > np.repeat(least, np.diff(np.append(starts, len(h))))
    return h[starts], least, h[later], d[later]


def per_document(hashes: np.ndarray, docs: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The distinct hashes of each document, as bytes."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])), len(h)) if len(h) else np.zeros(1, np.int64)
    return [int(d[a]) for a in cuts[:-1]], [h[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def per_team(hashes: np.ndarray, docs: np.ndarray, teams: int) -> dict[str, list]:
    """(document, hash) pairs packed into a row for each team of documents."""
    team = bucket_of(docs.view(np.uint64) * BASE, teams)
    order = np.lexsort((docs, team))
    h, d, runs = hashes[order], docs[order], np.searchsorted(team[order], np.arange(teams + 1))
    filled = np.flatnonzero(np.diff(runs))
    parts = [slice(runs[t], runs[t + 1]) for t in filled]
    return {"team": filled.tolist(), "owners": [planes(d[p]) for p in parts], "hashes": [planes(h[p]) for p in parts]}


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, text) -> (key, hashes): per document the windows that a smaller key also has.

    Rows between tasks are packed runs, one for each slab and bucket of hashes, then one for each bucket and team of
    documents, so their number depends on the tasks and not on the windows.
    """
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, int]] = []

        def settled() -> dict:
            hashes = np.concatenate([h for h, _ in held])
            owners = np.repeat(np.array([k for _, k in held], np.int64), [len(h) for h, _ in held])
            h, least, again, later = least_per_hash(hashes, owners)
            runs = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
            filled = np.flatnonzero(np.diff(runs)).tolist()
            own, base = [slice(runs[b], runs[b + 1]) for b in filled], least.min() if len(least) else 0
            done = per_team(again, later, buckets)
            return {
                "bucket": filled + done["team"],
                "team": [None] * len(filled) + done["team"],
                "base": [int(base)] * len(filled) + [None] * len(done["team"]),
                "hashes": [steps(h[p]) for p in own] + done["hashes"],
                "owners": [planes(least[p] - base) for p in own] + done["owners"],
            }

        waiting = 0
        for part in parts:
            for key, text in zip(part.column("key").to_pylist(), utf8(part.column("text")), strict=True):
                hashes = window_hashes(words(text), size)
                if key is not None and len(hashes):
                    held.append((hashes, key))
                    waiting += len(hashes)
                if waiting >= SLAB:
                    yield settled()
                    held.clear()
                    waiting = 0
        if held:
            yield settled()

    packed = StructType.fromDDL("team long, hashes binary, owners binary")
    packed_arrow = to_arrow_schema(packed)

    def earlier(table: pa.Table) -> pa.Table:
        """One bucket: what slabs have settled passes through, their entries meet."""
        done = table.filter(pc.is_valid(table["team"])).select(["team", "hashes", "owners"]).cast(packed_arrow)
        open_rows = table.filter(pc.is_null(table["team"]))
        if not open_rows.num_rows:
            return done
        hashes = np.concatenate([unstepped(b) for b in open_rows["hashes"].to_pylist()])
        bases = open_rows["base"].to_pylist()
        owners = np.concatenate([unplaned(b).view(np.int64) + base for b, base in zip(open_rows["owners"].to_pylist(), bases, strict=True)])
        _, _, again, later = least_per_hash(hashes, owners)
        return pa.concat_tables([done, pa.Table.from_batches([arrow(per_team(again, later, buckets), packed_arrow)])])

    answer = StructType.fromDDL("key long, hashes binary")
    answer_arrow = to_arrow_schema(answer)

    def regrouped(table: pa.Table) -> pa.Table:
        """One team: a row per document."""
        hashes = np.concatenate([unplaned(b) for b in table["hashes"].to_pylist()])
        owners = np.concatenate([unplaned(b) for b in table["owners"].to_pylist()]).view(np.int64)
        names, repeats = per_document(hashes, owners)
        return pa.Table.from_batches([arrow({"key": names, "hashes": repeats}, answer_arrow)])

    sent = map_stream(docs, entries, "bucket long, team long, base long, hashes binary, owners binary")
    return sent.groupBy("bucket").applyInArrow(earlier, packed).groupBy("team").applyInArrow(regrouped, answer)


def removed_words(hashes: np.ndarray, repeated: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Maximal intervals (start, end) of words covered by repeated windows, as rows."""
    starts = np.flatnonzero(np.isin(hashes, repeated))
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + size)
    return np.column_stack([starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + size])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its words, the removed ones, the kept text and the removed intervals of words.

    Result: ``key`` (an integer), ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space), ``intervals``. A window is removed if its words also
    start in a row with a smaller key; rows of one key don't count against each other, and rows with a null key neither lose
    nor cause anything. Every row gives one row; a null, empty or short text loses nothing. An empty table
    gives no rows. Other columns are not read.

    Windows are told apart by 64-bit hashes: for n windows in all, a false match of any given window has
    probability n / 2**64.
    """
    packed = docs.selectExpr(f"CAST(`{key}` AS bigint) AS key", f"`{text}` AS text")
    repeats = repeated_windows(packed, size).withColumnRenamed("key", "of")
    joined = packed.join(repeats, keys_match([(packed["key"], repeats["of"])]), "left").select("key", "text", "hashes")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "intervals": []}
        for body, blob in zip(utf8(batch.column("text")), batch.column("hashes").to_pylist(), strict=True):
            found = words(body)
            cut = np.zeros((0, 2), np.int64)
            if blob:
                cut = removed_words(window_hashes(found, size), np.frombuffer(blob, np.uint64), size)
            kept, at = [], 0
            for start, end in cut.tolist():
                kept += found[at:start]
                at = end
            kept += found[at:]
            out["n_words"].append(len(found))
            out["n_removed"].append(len(found) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode())
            out["intervals"].append([{"start": a, "end": b} for a, b in cut.tolist()])
        return {"key": batch.column("key")} | out

    schema = "key long, n_words long, n_removed long, kept_text string, intervals array<struct<start:bigint,end:bigint>>"
    return map_slices(joined, run, schema).withColumnRenamed("key", key)
