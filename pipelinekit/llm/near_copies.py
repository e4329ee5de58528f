"""Near copies by the similarity of their word shingles: SimHash links and MinHash bands propose pairs, shingle sets decide.

Texts of a similarity of 0.8 differ in up to 11 bits of their SimHash fingerprints. Bands that no such pair escapes would have 5 bits, and
put every 32nd text into one group. So besides the links of ``simhash``, pairs come from ``BANDS`` bands of ``ROWS`` minima of permuted
shingle hashes, each text of a band with two of them. These connect most groups, and what they miss is found by the first shingles of each text: in any
order that all texts share, two similar texts have one in common among their first ones, a fifth of each at 0.8. The order is
that of the hashes, behind which come the shingles that many texts have. Of texts with a first shingle in common, all that aren't connected
yet are compared: by the places and the number of such shingles, which bound what they can share, and by a sketch of parities, which bounds how far they
differ. None of these throws a similar pair out. Long texts share a shingle by chance, the more pairs of them the larger the corpus, but
seldom several; sets are fetched for the pairs that are left only. Every one of these is verified by both sets of shingles.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelinekit.llm.batches import map_slices, utf8, words
from pipelinekit.llm.components import components
from pipelinekit.llm.simhash import SEED, bit_counts, links
from pipelinekit.operators.conditions import keys_match
from pipelinekit.storage import stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
CHUNK = 1 << 13  # shingles permuted at a time
MANY = 3  # texts of a slice with a shingle that comes late in the order; no result depends on it
MARKS = 1 << 24  # bits that tell such shingles by their hash; no result depends on it
SKETCH = 8  # longs of parities
FEW = 64  # common first shingles that are counted at most; no result depends on it
CLOSE = 1e-9  # rounding of a bound


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word shingles, in order; of all words where there are fewer."""
    found = words(text.lower() if text else text)
    if not found:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(found)] if len(found) <= size else map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64)


def body_of(text: bytes | None) -> int:
    """A hash of a text's words: the same for texts that differ in white space or case only."""
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words(text.lower() if text else text)), SEED), "big", signed=True)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, BANDS * ROWS, np.uint64)


def band_keys(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> list[int]:
    """One long per band: the hash of its minima and its number."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    mixed = hashes ^ (hashes >> np.uint64(29))
    for i in range(0, len(mixed), CHUNK):
        # High bits of a product are well mixed, and order by them.
        least = np.minimum(least, (mixed[i : i + CHUNK, None] * factors + offsets).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def parities(hashes: np.ndarray) -> list[int]:
    """A bit per class of hashes: whether the set has an odd number of them. Two sets have at least as many different shingles as their sketches have different bits."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(key, text) -> (key, body, n, fingerprint, bands, sketch, often), ``n`` being how many shingles; a text without words has no bands.

    ``often`` is of a slice and stands in its first row: the shingles that ``MANY`` of its different texts have.
    """
    factors, offsets = permutations()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"body": [], "n": [], "fingerprint": [], "bands": [], "sketch": []}
        sets = {}
        for text in utf8(batch.column("text")):
            hashes = shingle_hashes(text, size)
            bits = bit_counts(hashes) * 2 > len(hashes)
            body = body_of(text)
            own = sets[body] = np.unique(hashes)
            out["body"].append(body)
            out["n"].append(len(own))
            out["fingerprint"].append(int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True))
            out["bands"].append(band_keys(own, factors, offsets) if len(hashes) else [])
            out["sketch"].append(parities(own))
        found, number = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = [found[number >= MANY].view(np.int64)] + [None] * (batch.num_rows - 1)
        return {"key": batch.column("key"), "often": often} | out

    return map_slices(docs, run, "key long, body long, n int, fingerprint long, bands array<long>, sketch array<long>, often array<long>")


def frequent(rows: DataFrame) -> np.ndarray:
    """The marks of frequent shingles, a bit for each of ``MARKS`` classes of hashes."""
    marks = rows.select(F.explode("often").alias("hash")).select((F.col("hash").bitwiseAND(F.lit(MARKS - 1)) + 1).alias("mark"))
    marks = marks.groupBy(F.bitmap_bucket_number("mark").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    found = np.zeros(MARKS // 8, np.uint8)
    for row in marks.toLocalIterator():
        part = np.frombuffer(bytes(row.bits), np.uint8)
        found[(row.part - 1) * len(part) : row.part * len(part)] = part
    return found


def first_shingles(docs: DataFrame, marks: np.ndarray, size: int, similarity: float) -> DataFrame:
    """(text) -> (body, n, first) of distinct texts: how many shingles, and those of them that come first in the common order."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"body": [], "n": [], "first": []}
        for text in utf8(batch.column("text")):
            hashes = np.unique(shingle_hashes(text, size))
            mark = (hashes & np.uint64(MARKS - 1)).astype(np.int64)
            late = marks[mark >> 3] >> (mark & 7).astype(np.uint8) & 1
            n = len(hashes)
            out["body"].append(body_of(text))
            out["n"].append(n)
            out["first"].append(hashes[np.argsort(late, kind="stable")][: n - math.ceil(similarity * n - CLOSE) + 1].view(np.int64))
        return out

    return map_slices(docs, run, "body long, n int, first array<long>").dropDuplicates(["body"])


def least_shared(x: str, y: str, similarity: float) -> Column:
    """How many shingles two similar texts share at least; no whole number."""
    return F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - CLOSE


def least_firsts(x: str, y: str, similarity: float) -> Column:
    """How many of their first shingles two similar texts share at least, or ``FEW`` if these are fewer; 1 at least.

    Common shingles that aren't first ones of both come after all first ones of one of them, so there are no more than that text has after its first ones.
    """
    after = F.ceil(F.lit(similarity) * F.greatest(f"{x}.n", f"{y}.n") - CLOSE) - 1
    return F.greatest(F.lit(1), F.least(F.lit(FEW), F.ceil(least_shared(x, y, similarity) - after)))


def may_be_similar(x: str, y: str, similarity: float) -> Column:
    """Whether a common shingle at these places can be one of the first ``least_firsts`` common ones of two similar texts."""
    before, rest = (F.least(*ends) for ends in ([f"{c}.place" for c in (x, y)], [F.col(f"{c}.n") - F.col(f"{c}.place") for c in (x, y)]))
    return rest + F.least(before, least_firsts(x, y, similarity) - 1) >= least_shared(x, y, similarity)


def too_far(x: str, y: str, similarity: float) -> Column:
    """Whether the sketches of two texts differ in more bits than similar ones have different shingles."""
    bits = reduce(Column.__add__, [F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(SKETCH)])
    return bits > F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + CLOSE


def shared_firsts(firsts: DataFrame) -> DataFrame:
    """(shingle, place, body, n, centre): first shingles that several texts have, and the text of each that has it first."""
    each = firsts.select("body", "n", F.posexplode("first").alias("place", "shingle"))
    group = Window.partitionBy("shingle")
    found = each.withColumns({"many": F.count(F.lit(1)).over(group), "centre": F.min(F.struct("place", "body", "n")).over(group)})
    return found.filter("many > 1").drop("many")


def unconnected(shared: DataFrame, rooted: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts with a first shingle in common that may be similar and have different roots.

    Of two roots at most one is the most frequent of a shingle, so one text of a pair is among the others. Where both are, the pair counts once.
    """
    own = rooted.select(F.col("body").alias("of"), "root")
    groups = stored(shared.drop("centre").join(own, keys_match([(shared["body"], own["of"])])).drop("of"), "groups")
    sizes = groups.groupBy(F.col("shingle").alias("by"), "root").count()
    chiefs = sizes.groupBy("by").agg(F.max_by("root", "count").alias("chief"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    mixed = groups.join(chiefs, keys_match([(groups["shingle"], chiefs["by"])])).drop("by", "roots")
    drawn = sketches.select(F.col("body").alias("of"), "sketch")
    mixed = stored(mixed.join(drawn, keys_match([(mixed["body"], drawn["of"])])).drop("of"), "mixed")
    x, y = mixed.filter("root != chief").alias("x"), mixed.alias("y")
    once = (F.col("y.root") == F.col("y.chief")) | (F.col("x.body") > F.col("y.body"))
    can = may_be_similar("x", "y", similarity) & ~too_far("x", "y", similarity)
    both = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & once & can)
    return sharing(both, similarity, 1)


def sharing(both: DataFrame, similarity: float, part: int) -> DataFrame:
    """(x, y) per common first shingle -> pairs (a, b) of bodies that have as many of them as similar texts, or that divided by ``part``."""
    each = both.select(F.greatest("x.body", "y.body").alias("a"), F.least("x.body", "y.body").alias("b"), least_firsts("x", "y", similarity).alias("want"))
    met = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("found"), F.max("want").alias("want"))
    return met.filter(F.col("found") * part >= F.col("want")).select("a", "b")


def candidates(nodes: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """(body, fingerprint, bands) -> pairs (a, b) of bodies, a > b: each text of a band with two of them, others in each band; equal and near fingerprints; each text with the centres of a quarter of the first shingles that similar texts share."""
    banded = nodes.select("body", F.explode("bands").alias("band"))
    least = banded.groupBy(F.col("band").alias("of")).agg(*[f("body", F.xxhash64("body", "band")).alias(c) for f, c in ((F.min_by, "other"), (F.max_by, "last"))]).filter("other != last")
    stars = banded.join(least, keys_match([(banded["band"], least["of"])])).select("body", "other", "last")
    pairs = stars.select(F.col("body").alias("a"), F.col("other").alias("b")).union(stars.select(F.col("last").alias("a"), F.col("body").alias("b")))
    alike = nodes.groupBy(F.col("fingerprint").alias("print")).agg(F.min("body").alias("first"))
    same = nodes.join(alike, keys_match([(nodes["fingerprint"], alike["print"])])).select(F.col("body").alias("a"), F.col("first").alias("b"))
    near = links(nodes.select("fingerprint").distinct()).toDF("x", "y")
    ends = [alike.select(F.col("print").alias(f"of_{c}"), F.col("first").alias(c)) for c in ("a", "b")]
    bits = near.join(ends[0], F.col("x") == F.col("of_a")).join(ends[1], F.col("y") == F.col("of_b")).select("a", "b")
    hubs = shared.select(F.struct("place", "body", "n").alias("x"), F.col("centre").alias("y"))
    hubs = sharing(hubs.filter("x.body != y.body").filter(may_be_similar("x", "y", similarity)), similarity, 4)
    every = pairs.union(same).union(bits).union(hubs).filter("a != b")
    return every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_enough(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose numbers of shingles and sketches allow them to be similar."""
    x, y = (nodes.select(F.struct("body", "n", "sketch").alias(c)) for c in ("x", "y"))
    both = pairs.join(x, keys_match([(F.col("a"), F.col("x.body"))])).join(y, keys_match([(F.col("b"), F.col("y.body"))]))
    fits = F.least("x.n", "y.n") >= least_shared("x", "y", similarity)
    return both.filter(fits & ~too_far("x", "y", similarity)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar by ``similarity`` or more."""
    left, right = (sets.select(F.col("body").alias(f"of_{c}"), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
    both = pairs.join(left, keys_match([(pairs["a"], left["of_a"])])).select("a", "b", "set_a")
    both = both.join(right, keys_match([(both["b"], right["of_b"])])).select("a", "b", "set_a", "set_b")

    def run(batch: pa.RecordBatch) -> dict:
        found = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            found.append(shared >= similarity * (len(x) + len(y) - shared))
        return {c: batch.column(c).filter(pa.array(found, pa.bool_())) for c in ("a", "b")}

    return map_slices(both, run, "a long, b long")


def one_of_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest key (an integer) of their group of near copies; columns as before.

    Texts are near copies if the sets of their shingles of ``size`` words are similar by ``similarity`` or more, directly or over others;
    texts without words are copies of each other. Of several rows with that key one stays. Rows with a null key can't be told apart and all stay.
    No link is lost: texts that the proposed pairs leave unconnected are compared wherever they can be similar. Texts are told apart by 64-bit hashes, as are shingles.
    """
    packed = docs.filter(F.col(key).isNotNull()).selectExpr(f"CAST(`{key}` AS bigint) AS key", f"`{text}` AS text")
    rows = stored(signatures(packed, size), "signatures")
    least = stored(rows.groupBy("body").agg(F.min("key").alias("least"), F.min("fingerprint").alias("fingerprint")), "bodies")
    bands = rows.select("body", "n", "bands", "sketch").dropDuplicates(["body"])
    nodes = stored(least.join(bands.withColumnRenamed("body", "same"), F.col("body") == F.col("same")).select("body", "n", "fingerprint", "bands", "sketch"), "nodes")
    shared = stored(shared_firsts(first_shingles(packed.select("text"), frequent(rows), size, similarity)), "first-shingles")

    def shingles(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column("text"))
        return {"body": [body_of(t) for t in texts], "shingles": [np.unique(shingle_hashes(t, size)).tobytes() for t in texts]}

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = stored(near_enough(pairs, nodes, similarity), "candidates")
        ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
        wanted = stored(least.join(ends, F.col("body") == F.col("end")).select(F.col("least").alias("of")).distinct(), "wanted")
        asked = packed.join(wanted, keys_match([(packed["key"], wanted["of"])])).select("text")
        sets = stored(map_slices(asked, shingles, "body long, shingles binary").dropDuplicates(["body"]), "shingles")
        return verified(pairs, sets, similarity)

    def with_roots(edges: DataFrame) -> DataFrame:
        return stored(least.join(components(edges), F.col("body") == F.col("node"), "left").select("body", "least", F.coalesce("root", "body").alias("root")), "roots")

    rooted = with_roots(similar(candidates(nodes, shared, similarity)))
    rest = similar(unconnected(shared, rooted, nodes, similarity))
    rooted = with_roots(rooted.select(F.col("body").alias("a"), F.col("root").alias("b")).union(rest))
    stays = rooted.groupBy("root").agg(F.min("least").alias("__stays")).select("__stays").distinct()
    # One row per key first: keys aren't frequent then, and texts move once.
    kept = docs.filter(F.col(key).isNotNull()).dropDuplicates([key])
    kept = kept.join(stays, kept[key] == stays["__stays"], "left_semi")
    return kept.unionByName(docs.filter(F.col(key).isNull()))
