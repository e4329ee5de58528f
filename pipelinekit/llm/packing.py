"""Documents packed into token sequences by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of at most one sequence; full pieces are sequences by themselves. The
others are dealt at random into blocks, and every block is packed on several islands. An island
keeps a few packings: the first by best fit in descending, the others in random order. A crossover injects well-filled
sequences of one parent whole into the other, drops the sequences there that hold the same pieces, and best-fits
the displaced ones. Between epochs every island's best packing migrates to the next island of its block. At last, what
the best packing of each block leaves in poorly filled sequences is dealt into blocks and packed once more.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipelinekit.llm.batches import map_stream
from pipelinekit.storage import stored

LENGTH = 2048
END_ID = 0
BLOCK = 3000  # pieces packed together
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 6  # crossovers in an epoch
WELL_FILLED = 0.99  # of a sequence; what crossovers inject
SETTLED = 0.995  # of a sequence; fuller ones stay after the first round
CACHE_WORDS = 150_000  # distinct words whose ids a task holds, and as many older ones

EDGE = ".,!?;:$&%*#|"
# Characters for which lower case, normal form or white space may differ between Python and the tokenizer.
ODD = regex.compile("[\u0300-\U0010ffff\x1c-\x1f]")
# The tokenizer writes each byte of a word as a character: visible ones of Latin-1 as themselves, the others from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
WRITTEN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in VISIBLE)}


class WordIds:
    """Ids of texts by a tokenizer whose pieces never span white space, word by word with a cache.

    Words are cut off their trailing marks, which the tokenizer splits off too, as one piece. Texts with characters for which lower-casing
    or white space may differ between here and the tokenizer go through the tokenizer as a whole, as do those with the string of one of its special
    tokens, which it takes for that token.
    """

    def __init__(self, model: str) -> None:
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}  # what the cache held before it was last emptied
        self.tails: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = []
        for i in range(0, len(texts), 500):  # what the tokenizer returns takes far more memory than the ids
            found += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts[i : i + 500], add_special_tokens=False)]
        return found

    def learn(self, found: set[str]) -> None:
        cache, merged, rest = self.cache, self.tokenizer.model.tokenize, []
        for word in found:
            core = word if word.isalpha() else word.rstrip(EDGE)
            if not core.isalpha():
                rest.append(word)
                continue
            # A word of letters is one piece, to which merges apply directly; so are the marks behind it.
            known = cache.get(core)
            if known is None:
                written = core if core.isascii() else core.encode().decode("latin-1").translate(WRITTEN)
                known = array("I", [t.id for t in merged(written)]).tobytes()
            if core is not word:
                tail = word[len(core) :]
                if tail not in self.tails:
                    self.tails[tail] = array("I", [t.id for t in merged(tail)]).tobytes()
                known += self.tails[tail]
            cache[word] = known
        cache.update(zip(rest, self.encoded(rest), strict=True))

    def words(self, text: str) -> list[str] | None:
        """The words of a text, none if it is for the tokenizer as a whole."""
        lowered = text.lower()
        return None if ODD.search(text) or any(token in lowered for token in self.special) else lowered.split()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit numbers, without an end."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.former = {}, self.cache
        split = [self.words(text or "") for text in texts]
        missing = {w for found in split if found for w in found} - self.cache.keys()
        known = missing & self.former.keys()
        self.cache.update((w, self.former[w]) for w in known)
        self.learn(missing - known)
        whole = iter(self.encoded([t for t, found in zip(texts, split, strict=True) if found is None]))
        get = self.cache.__getitem__
        return [next(whole) if found is None else b"".join(map(get, found)) for found in split]


def pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, piece, start, length, ids_crc32, place) of every row; ``place`` tells pieces apart."""
    kind = docs.select(key).schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file, a few MB whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = WordIds(shared.value)
        end = np.array([END_ID], "<u4").tobytes()
        for part in parts:
            rows, owners = [], []
            for i, body in enumerate(words.ids(part.column("text").to_pylist())):
                body += end
                for n, at in enumerate(range(0, len(body), 4 * length)):
                    piece = body[at : at + 4 * length]
                    rows.append((n, at // 4, len(piece) // 4, zlib.crc32(piece)))
                    owners.append(i)
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            taken = part.column("key").take(pa.array(owners, pa.int64()))
            yield {"key": taken} | dict(zip(("piece", "start", "length", "ids_crc32"), columns, strict=True))

    rows = map_stream(docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, f"key {kind}, piece int, start long, length long, ids_crc32 long")
    return rows.withColumn("place", F.monotonically_increasing_id())


Packing = list[tuple[int, list[int]]]  # (free tokens, pieces) of each sequence


def best_fit(order: list[int], sizes: list[int], bins: Packing, length: int) -> Packing:
    """Put pieces, in the order given, into the fullest sequence that has room, or into a new one."""
    bins = list(bins)
    free = sorted((room, i) for i, (room, _) in enumerate(bins) if room)
    owned = [False] * len(bins)
    for item in order:
        size = sizes[item]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, i = free.pop(at)
            held = bins[i][1]
            if not owned[i]:
                held, owned[i] = held.copy(), True
            held.append(item)
            bins[i] = (room - size, held)
        else:
            i, room = len(bins), length
            bins.append((room - size, [item]))
            owned.append(True)
        if room > size:
            insort(free, (room - size, i))
    return bins


def worth(bins: Packing, length: int) -> tuple[int, float]:
    """Fewer sequences are better, then more uneven ones: mean square fill."""
    return -len(bins), sum(((length - room) / length) ** 2 for room, _ in bins) / max(1, len(bins))


def crossover(into: Packing, giver: Packing, sizes: list[int], length: int, rng: np.random.Generator) -> Packing:
    """Inject well-filled sequences of ``giver`` into ``into`` and best-fit what they displace."""
    filled = [b for b in giver if b[0] <= length * (1 - WELL_FILLED)]
    given = [b for b, chosen in zip(filled, rng.random(len(filled)) < 0.5, strict=True) if chosen]
    taken = {item for _, held in given for item in held}
    stay, displaced = [], []
    for b in into:
        if taken.isdisjoint(b[1]):
            stay.append(b)
        else:
            displaced += [item for item in b[1] if item not in taken]
    # The emptiest sequences are dissolved too: only whole ones can be saved.
    stay.sort(key=lambda b: b[0])
    loose = max(1, len(stay) // 20)
    for _, held in stay[-loose:]:
        displaced += held
    displaced.sort(key=lambda item: -sizes[item])
    return best_fit(displaced, sizes, stay[:-loose] + given, length)


def evolve(sizes: list[int], elites: list[Packing], length: int, seed: int) -> Packing:
    """One epoch of an island; its best packing. Immigrants and its own former best are in ``elites``."""
    rng = np.random.default_rng(seed)
    if sum(sizes) <= length:
        return best_fit(list(range(len(sizes))), sizes, [], length)
    lower = -(-sum(sizes) // length)
    people = list(elites)
    if not people:
        people.append(best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, [], length))
    if min(map(len, people)) == lower:  # nothing can be better
        return min(people, key=len)
    while len(people) < POPULATION:
        blurred = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
        people.append(best_fit(np.argsort(-blurred).tolist(), sizes, [], length))
    people.sort(key=lambda p: worth(p, length), reverse=True)
    for _ in range(OFFSPRING):
        if len(people[0]) == lower:
            break
        a, b = sorted(rng.choice(len(people), 2, replace=False))
        child = crossover(people[a], people[b], sizes, length, rng)
        people.append(child)
        people.sort(key=lambda p: worth(p, length), reverse=True)
        people.pop()
    return people[0]


def _epoch(rows: DataFrame, number: int, length: int) -> DataFrame:
    """(block, island, origin, place, length, bin) -> the best packing of each island; bin is null at first."""

    def island(part: pd.DataFrame) -> pd.DataFrame:
        block, number_of = int(part["block"].iloc[0]), int(part["island"].iloc[0])
        items = part.drop_duplicates("place").sort_values("place")
        at = {place: i for i, place in enumerate(items["place"].tolist())}
        sizes = items["length"].tolist()
        elites: list[Packing] = []
        for _, one in part[part["bin"] >= 0].groupby("origin"):
            held: dict[int, list[int]] = {}
            for place, b in zip(one["place"].tolist(), one["bin"].tolist(), strict=True):
                held.setdefault(b, []).append(at[place])
            elites.append([(length - sum(sizes[i] for i in several), several) for several in held.values()])
        best = evolve(sizes, elites, length, (block * 31 + number_of) * 31 + number)
        bins, rooms = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, (room, held) in enumerate(best):
            bins[held], rooms[held] = b, room
        score = worth(best, length)
        return pd.DataFrame({"block": block, "island": number_of, "place": items["place"].to_numpy(), "length": sizes, "bin": bins, "room": rooms, "score": score[0] + score[1]})

    return rows.groupBy("block", "island").applyInPandas(island, "block long, island int, place long, length long, bin long, room long, score double")


def pack_blocks(rows: DataFrame, length: int = LENGTH, islands: int = ISLANDS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """(place, length) -> (block, place, length, bin, room): the best island's packing of each block."""
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.select(F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block"), "place", "length")
    start = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    now = start.withColumns({"origin": F.col("island"), "bin": F.lit(-1).cast("long")})
    for number in range(epochs):
        best = stored(_epoch(now.select("block", "island", "origin", "place", "length", "bin"), number, length), "islands")
        # Every island goes on with its own best packing and that of the island before.
        goes = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).alias("to")
        now = best.select("block", F.col("island").alias("origin"), "place", "length", "bin", goes).withColumnRenamed("to", "island")
    winners = best.groupBy("block").agg(F.max_by("island", F.struct("score", -F.col("island"))).alias("winner"))
    return best.join(winners, "block").filter("island = winner").select("block", "place", "length", "bin", "room")


def pack(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``length`` tokens.

    Result, a row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. ``model`` is the content of a tokenizer file.
    A null or empty text is its end id alone. Longer ones are cut at whole sequences. Repeated rows are packed
    each for itself, null keys too. An empty table gives no rows. Other columns are not read.
    """
    cut = stored(pieces(docs, model, key, text, length), "pieces")
    part = cut.filter(F.col("length") < length).select("place", "length")
    once = stored(pack_blocks(part, length), "packed")
    loose = F.col("room") > length * (1 - SETTLED)
    again = stored(pack_blocks(once.filter(loose).select("place", "length"), length), "repacked")
    full = cut.filter(F.col("length") == length).select("place", "length", F.struct(F.lit(0).alias("round"), F.col("place").alias("block"), F.lit(0).cast("long").alias("bin")).alias("of"))
    named = [
        rows.select("place", "length", F.struct(F.lit(number).alias("round"), "block", "bin").alias("of"))
        for number, rows in ((1, once.filter(~loose)), (2, again))
    ]
    placed = full.unionByName(named[0]).unionByName(named[1])
    # A sequence holds at most ``length`` pieces, so its window is bounded. A sequence is named by its first piece.
    by = Window.partitionBy("of").orderBy("place")
    offset = F.coalesce(F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spots = placed.select("place", F.first("place").over(by).alias("sequence_id"), offset.alias("offset"))
    return cut.join(spots, "place").select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
