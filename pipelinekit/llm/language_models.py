"""Cross-entropy difference of two bigram models: one of a target domain, one of everything else.

Both models share one vocabulary, all words that the corpus has often enough, and are of the same form: a bigram estimate
interpolated with a smoothed unigram estimate. Counts are taken over all documents. The background counts are brought to the
target's total, so smoothing weighs the same in both. A document's score is the mean over its
words of the background's loss minus the target's: positive if the target model predicts it better.

Texts are read once, into a table of slabs: some thousand documents each, their words as numbers of the slab's distinct words. A slab sends each of its
distinct words, and then each of its distinct bigrams, once to the part of all hashes that it belongs to, where the counts of all slabs are added up. The sums come
back in the order in which the slab sent its hashes, so no hash travels back, and the slab prices its own documents. Nothing but totals
comes to the driver, no task holds a model, and texts don't move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pipelinekit.llm.batches import arrow, map_stream, utf8, words
from pipelinekit.llm.substrings import bucket_of, planes, steps, unplaned, unstepped
from pipelinekit.operators.conditions import keys_match
from pipelinekit.storage import stored

LEAST = 1  # times that the corpus has a word of the vocabulary, at least
START, OTHER = 0, 1  # stand before the first word and for all words out of the vocabulary
BIGRAM = 0.7  # weight of the bigram estimate
MIX = np.uint64(0x9E3779B97F4A7C15)
SLAB_WORDS = 2_000_000  # a slab is closed when it has so many words
SLAB_ROWS = 31_000  # or rows; one of Spark's bitmaps has 32,768 bits, and a slice 1,000 rows at most
PART_HASHES = 2_000_000  # that a part gets at most, about
COUNTS = "slab long, part int, hashes binary, counts binary"
SUMS = "slab long, part int, counts binary, kinds long, totals array<long>"


def tokens(text: bytes | None) -> list[bytes]:
    return words(text.lower() if text else text)


def hashed(text: bytes | None) -> np.ndarray:
    found = tokens(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def slabs_of(docs: DataFrame, kind: str) -> DataFrame:
    """(key, text) -> a row per slab: keys, lengths of texts, all words as numbers (the more frequent, the smaller), the hashes of the distinct words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        texts: list[np.ndarray] = []

        def closed() -> dict:
            found, place, often = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            row = {"slab": [number], "keys": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(keys))}
            return row | {"lengths": [[len(t) for t in texts]], "ids": [planes(rank[place])], "words": [found[order].tobytes()], "n": [len(place)], "kinds": [len(found)]}

        waiting = 0
        for part in parts:
            keys.append(part.column("key"))
            texts += (read := [hashed(t) for t in utf8(part.column("text"))])
            waiting += sum(map(len, read))
            if waiting >= SLAB_WORDS or len(texts) >= SLAB_ROWS:
                yield closed()
                number, waiting = number + 1, 0
                keys.clear()
                texts.clear()
        if texts:
            yield closed()

    return map_stream(docs, run, f"slab long, keys array<{kind}>, lengths array<int>, ids binary, words binary, n long, kinds long")


def opened(lengths: pa.Array, ids: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return lengths.to_numpy(zero_copy_only=False).astype(np.int64), unplaned(ids).view(np.int64), np.frombuffer(hashes, np.uint64)


def paired(lengths: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts: the number of the one before it (for the first one, the number after the last), and the bigram's hash."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(hashes)
    of = np.append(hashes, np.uint64(START))
    return before, of[before] * MIX + of[ids]


def word_counts(lengths: np.ndarray, ids: np.ndarray, hashes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words; how often target and background have each, and how often as the last word of a text."""
    last = np.cumsum(lengths)[lengths > 0] - 1
    counts = [np.bincount(ids[at][near[at] == own], minlength=len(hashes)) for at in (slice(None), last) for own in (True, False)]
    order = np.argsort(hashes)
    return hashes[order], np.stack(counts).astype(np.int64)[:, order]


def bigram_counts(lengths: np.ndarray, ids: np.ndarray, hashes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams; how often target and background have each."""
    found, place = np.unique(paired(lengths, ids, hashes)[1], return_inverse=True)
    return found, np.stack([np.bincount(place[near == own], minlength=len(found)) for own in (True, False)]).astype(np.int64)


def sent(slabs: DataFrame, marks: DataFrame, count, parts: int) -> DataFrame:
    """``count`` of each slab, in a row for each part of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in range(batch.num_rows):
                slab, ids, hashes, bits = (batch.column(c)[row].as_py() for c in ("slab", "ids", "words", "bits"))
                texts = opened(batch.column("lengths")[row].values, ids, hashes)
                wanted = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: len(texts[0])] if bits else np.zeros(len(texts[0]))
                found, counts = count(*texts, np.repeat(wanted.astype(bool), texts[0]))
                runs = np.searchsorted(bucket_of(found, parts), np.arange(parts + 1))
                filled = np.flatnonzero(np.diff(runs)).tolist()
                own = [slice(runs[p], runs[p + 1]) for p in filled]
                yield {"slab": [slab] * len(own), "part": filled, "hashes": [steps(found[p]) for p in own], "counts": [planes(counts[:, p]) for p in own]}

    # The marks are a bit per document: they go to the slabs, which stay where they are.
    marked = slabs.join(F.broadcast(marks), "slab", "left").select("slab", "lengths", "ids", "words", "bits")
    return map_stream(marked, run, COUNTS, most=1)


def added(counts: DataFrame) -> DataFrame:
    """Each slab's counts, added up over all slabs; each part's number of kinds and its totals, in one of its rows."""
    schema = to_arrow_schema(StructType.fromDDL(SUMS))

    def run(table: pa.Table) -> pa.Table:
        hashes = [unstepped(b) for b in table["hashes"].to_pylist()]
        each = np.concatenate([unplaned(b).view(np.int64).reshape(-1, len(h)) for b, h in zip(table["counts"].to_pylist(), hashes, strict=True)], axis=1)
        found, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.stack([np.bincount(place, c, len(found)) for c in each]).astype(np.int64)
        back = [planes(sums[:, p]) for p in np.split(place, np.cumsum([len(h) for h in hashes])[:-1])]
        rest = len(back) - 1
        kinds, totals = int(np.count_nonzero(found != OTHER)), sums.sum(axis=1).tolist()
        columns = {"slab": table["slab"].combine_chunks(), "part": table["part"].combine_chunks(), "counts": back, "kinds": [kinds, *[0] * rest], "totals": [totals, *[None] * rest]}
        return pa.Table.from_batches([arrow(columns, schema)])

    return counts.groupBy("part").applyInArrow(run, StructType.fromDDL(SUMS))


def returned(rows: pa.Table, of: str, size: int, kinds: int) -> np.ndarray:
    """A slab's sums, in the order of its hashes."""
    own = rows.filter(pc.equal(rows["of"], of)).sort_by("part")["counts"].to_pylist()
    return np.concatenate([unplaned(b).view(np.int64).reshape(size, -1) for b in own] or [np.zeros((size, kinds), np.int64)], axis=1)


def by_slab(slabs: DataFrame, sums: DataFrame, function, schema: StructType) -> DataFrame:
    """``function`` of each slab's row and its sums."""
    target = to_arrow_schema(schema)

    def run(slab: pa.Table, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([arrow(function({c: slab[c].combine_chunks()[0] for c in slab.column_names}, rows), target)])

    return slabs.groupBy("slab").cogroup(sums.groupBy("slab")).applyInArrow(run, schema)


def common_words(slabs: DataFrame, sums: DataFrame, least: int, size: int | None) -> DataFrame:
    """The slabs with one word in place of all that are not in the vocabulary."""
    cut: tuple[int, int] | None = (0, 0)
    if size is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for ids, hashes in zip(batch.column("ids").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    found = np.frombuffer(hashes, np.int64)
                    yield {"word": found, "n": np.bincount(unplaned(ids).view(np.int64), minlength=len(found))}

        often = map_stream(slabs.select("ids", "words"), run, "word long, n long", most=1).groupBy("word").agg(F.sum("n").alias("n"))
        last = often.orderBy(F.desc("n"), "word").limit(max(0, size - 2)).orderBy("n", F.desc("word")).first()
        cut = (last["n"], last["word"]) if last else None

    def replaced(slab: dict, rows: pa.Table) -> dict:
        hashes = np.frombuffer(slab["words"].as_py(), np.uint64)
        n = np.zeros(len(hashes), np.int64)
        n[np.argsort(hashes)] = returned(rows, "word", 4, len(hashes))[:2].sum(axis=0)
        known = (n >= least) & (cut is not None)
        if size is not None and cut:
            known &= (n > cut[0]) | ((n == cut[0]) & (hashes.view(np.int64) <= cut[1]))
        number = np.where(known, np.cumsum(known) - 1, np.count_nonzero(known))
        kept = hashes[known] if known.all() else np.append(hashes[known], np.uint64(OTHER))
        changed = {"ids": [planes(number[unplaned(slab["ids"].as_py()).view(np.int64)])], "words": [kept.tobytes()], "kinds": [len(kept)]}
        return {c: pa.array([v.as_py()], v.type) for c, v in slab.items()} | changed

    return by_slab(slabs, sums, replaced, slabs.schema)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = None, least: int = LEAST) -> DataFrame:
    """Score every row of ``docs`` against the target domain, the documents whose keys ``target`` has.

    Result: ``key``, n_words, target_loss, background_loss (means per word, in nats), score (their difference, higher is closer to
    the target). Rows without words have losses and score 0. A null key is background. Every row gives one row, repeated
    ones too, and counts as often as it is there. Without target documents the target model is uniform. An empty table
    gives no rows. Other columns are not read.

    The vocabulary are the words that all documents together have ``least`` times or more, by default every word; ``size`` keeps the
    ``size - 2`` most frequent of them. Words and bigrams are told apart by 64-bit hashes.
    """
    kind = docs.select(key).schema[key].dataType.simpleString()
    slabs = stored(slabs_of(docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), kind), "slabs")
    wanted = target.select(F.col(key).alias("of")).filter(F.col("of").isNotNull()).distinct()
    places = slabs.select("slab", F.posexplode("keys").alias("place", "key"))
    met = places.join(wanted, keys_match([(places["key"], wanted["of"])]))
    marks = stored(met.groupBy("slab").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")), "marks")
    n, kinds = slabs.agg(F.sum("n"), F.sum("kinds")).first()

    def summed(count, hashes: int | None) -> DataFrame:
        return added(sent(slabs, marks, count, 1 + (hashes or 0) // PART_HASHES))

    single = stored(summed(word_counts, kinds), "words")
    if least > 1 or size is not None:
        slabs = stored(common_words(slabs, single.withColumn("of", F.lit("word")), least, size), "known")
        single = stored(summed(word_counts, kinds), "words")
    seen, *totals = single.agg(F.sum("kinds"), *[F.sum(F.col("totals")[i]) for i in range(4)]).first()
    totals = np.array([t or 0 for t in totals], np.int64)
    every = size or (seen or 0) + 2
    scale = totals[0] / totals[1] if totals[0] and totals[1] else 1.0

    def priced(slab: dict, rows: pa.Table) -> dict:
        lengths, ids, hashes = opened(slab["lengths"].values, slab["ids"].as_py(), slab["words"].as_py())
        of_word = np.zeros((4, len(hashes)), np.int64)
        of_word[:, np.argsort(hashes)] = returned(rows, "word", 4, len(hashes))
        # What stands before a word: all words but the last ones, and as many starts as there are last ones.
        ahead = np.column_stack([of_word[:2] - of_word[2:], totals[2:]])
        before, grams = paired(lengths, ids, hashes)
        found, first, place = np.unique(grams, return_index=True, return_inverse=True)
        pairs = returned(rows, "bigram", 2, len(found))
        text = np.repeat(np.arange(len(lengths)), lengths)
        losses = []
        for i, times in enumerate((1.0, scale)):
            one = (of_word[i, ids[first]] * times + 1) / float(totals[i] * times + every)
            prev = ahead[i, before[first]]
            loss = -np.log(np.where(prev > 0, BIGRAM * pairs[i] / np.maximum(prev, 1) + (1 - BIGRAM) * one, one))
            losses.append(np.bincount(text, loss[place], len(lengths)) / np.maximum(lengths, 1))
        near, far = losses
        return {key: slab["keys"].values, "n_words": lengths, "target_loss": near, "background_loss": far, "score": far - near}

    columns = ("slab", "part", "counts")
    sums = single.select(*columns, F.lit("word").alias("of")).unionByName(summed(bigram_counts, n).select(*columns, F.lit("bigram").alias("of")))
    result = StructType.fromDDL(f"`{key}` {kind}, n_words long, target_loss double, background_loss double, score double")
    return by_slab(slabs.select("slab", "keys", "lengths", "ids", "words"), sums, priced, result)
