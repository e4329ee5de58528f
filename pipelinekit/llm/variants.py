"""Spelling variants: words of a corpus that differ by one letter, each led to the far more frequent form next to it.

One edit changes the letter counts of a word by at most two: a letter less and another more, or one more. So the words
of each length form a k-d tree over their letter counts, in which a word searches the box of its own length (at most one count up
and one down) and that of the next length (one up). The upper tree is grown in Spark, all cells of all lengths by one
level a round, from counts of all words, until cells hold at most ``CELL`` words; searching words descend the same rounds and fork where a
cut lies within reach. Each cell is then searched by a small k-d tree of its own. What shares nearly all letters is
compared letter by letter at last.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelinekit.llm.batches import map_stream, utf8
from pipelinekit.storage import stored

CELL = 16_000  # words of a cell; one of words with the same letters may be larger
SEARCHES = 40_000  # searches in a cell that one task makes; more are divided
LEAF = 32  # words of a leaf within a cell
BLOCK = 1024  # words and searches compared at once
DISTINCT = 100_000  # words counted in a task before they are passed on; no result depends on it
FACTOR = 5  # how much more frequent a form is

RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def without(run: bytes, at: int) -> bytes:
    """A run without the code point at a place."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def spelled_words(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int | None = 199) -> DataFrame:
    """``word`` and its occurrences ``n`` over all documents.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. With ``drop``, let h be the unsigned crc32 of ``<key>:<run>``: where
    ``drop`` divides it, the run loses its code point h % length, and what is left, if anything, is the word. A null text has no
    words; a null key is written as nothing before the colon. Rows are counted as often as they occur.
    """

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: Counter[bytes] = Counter()

        def flushed() -> dict:
            columns = {"word": pa.array(list(total), pa.binary()).cast(pa.string()), "n": list(total.values())}
            total.clear()
            return columns

        for part in parts:
            for name, whole in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                prefix = b"%s:" % (b"" if name is None else str(name).encode())
                # Bytes have no other capitals than A-Z.
                for run, n in Counter(RUN.findall(whole.lower())).items() if whole else ():
                    word = run
                    if drop is not None:
                        h = zlib.crc32(prefix + run)
                        if h % drop == 0:
                            word = without(run, h % len(run.decode()))
                    if word:
                        total[word] += n
                    if len(total) >= DISTINCT:
                        yield flushed()
        yield flushed()

    found = map_stream(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def letters(word: Column) -> Column:
    """The distinct letters of a word."""
    return F.array_distinct(F.split(word, ""))


def count_of(word: Column, letter: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, letter, F.lit("")))


def _cuts(words: DataFrame) -> DataFrame:
    """The best cut (``letter`` in ``least`` places or more against fewer) of each cell of more than ``CELL`` words, if any parts it."""
    sizes = words.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > CELL)
    large = words.join(sizes, ["size", "cell"])
    each = large.select("size", "cell", "rows", "word", F.explode(letters(F.col("word"))).alias("letter"))
    each = each.withColumn("least", F.explode(F.sequence(F.lit(1), count_of(F.col("word"), F.col("letter")))))
    shares = each.groupBy("size", "cell", "letter", "least").agg(F.count(F.lit(1)).alias("with"), F.first("rows").alias("rows"))
    parting = shares.filter(F.col("with") < F.col("rows"))
    best = F.min_by(F.struct("letter", "least"), F.struct(F.abs(2 * F.col("with") - F.col("rows")), F.col("letter"), F.col("least")))
    return parting.groupBy("size", "cell").agg(best.alias("cut")).select("size", "cell", "cut.letter", "cut.least")


def _descended(searches: DataFrame, cuts: DataFrame) -> DataFrame:
    """Searches one level down: to their own side of the cut, and to the other one if what they have left reaches it."""
    here = searches.join(cuts, ["size", "cell"], "left")
    count = count_of(F.col("word"), F.col("letter"))
    up, down = F.greatest(F.col("least") - count, F.lit(0)), F.greatest(count - F.col("least") + 1, F.lit(0))

    def side(name: str, up: Column, down: Column) -> Column:
        cell = F.concat("cell", F.lit(name))
        return F.struct(cell.alias("cell"), (F.col("up") - up).alias("up"), (F.col("down") - down).alias("down"))

    none = F.lit(0)
    sides = F.filter(F.array(side("l", none, down), side("r", up, none)), lambda s: (s["up"] >= 0) & (s["down"] >= 0))
    same = F.array(F.struct(F.col("cell"), F.col("up"), F.col("down")))
    to = F.explode(F.when(F.col("letter").isNull(), same).otherwise(sides)).alias("to")
    return here.select("size", "word", "n", to).select("size", "to.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near`` and their ``n`` and ``near_n``, for all pairs that differ by one inserted, deleted or replaced code point, both ways.

    ``words`` has distinct words and their ``n``. Words of the same letters in another order never differ by one edit, and a cell of only such
    words is not cut further.
    """
    start = [F.length("word").alias("size"), F.lit("").alias("cell")]
    points = stored(words.select(*start, "word", "n"), "points")
    here = words.select(*start, F.lit(1).alias("up"), F.lit(1).alias("down"), "word", "n")
    longer = words.select((F.length("word") + 1).alias("size"), F.lit("").alias("cell"), F.lit(1).alias("up"), F.lit(0).alias("down"), "word", "n")
    searches = stored(here.unionByName(longer), "searches")
    while True:
        cuts = stored(_cuts(points), "cuts")
        if cuts.isEmpty():
            break
        # A word is in one cell only: nothing is left to go up or down.
        still = points.select("size", "cell", F.lit(0).alias("up"), F.lit(0).alias("down"), "word", "n")
        points = stored(_descended(still, cuts).drop("up", "down"), "points")
        searches = stored(_descended(searches, cuts), "searches")

    many = searches.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("parts"))
    filled = points.select("size", "cell").distinct()
    shares = many.join(filled, ["size", "cell"])
    named = [F.concat_ws("|", F.col("size").cast("string"), "cell", F.col("part").cast("string")).alias("group"), F.col("size"), F.col("asks"), F.col("word"), F.col("n")]
    in_cells = points.join(shares, ["size", "cell"]).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "asks": F.lit(False)})
    asked = searches.join(shares, ["size", "cell"]).withColumns({"part": F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), "asks": F.lit(True)})
    together = in_cells.select(*named).unionByName(asked.select(*named)).repartition("group").sortWithinPartitions("group", "asks")
    pairs = map_stream(together, _searched, "word string, near string, n long, near_n long", SEARCHES)
    # Words of one length each search the other; a longer one is only found by the shorter.
    other = pairs.filter(F.length("word") < F.length("near")).select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n"))
    return pairs.unionByName(other)


def _searched(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The pairs of a stream of cells, each with its words first and the searching words after them."""
    now, words, tree = None, [], None
    for part in parts:
        asks = np.array(part.column("asks").to_pylist(), bool)
        runs = pc.run_end_encode(part.column("group"))
        ends = np.union1d(runs.run_ends.to_numpy(), np.flatnonzero(asks[1:] != asks[:-1]) + 1)
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            some = part.slice(start, end - start)
            group, asking = some.column("group")[0].as_py(), bool(asks[start])
            if group != now:
                now, words, tree = group, [], None
            if not asking:
                words.append(some)
                continue
            if not words:
                continue
            if tree is None:
                held = pa.Table.from_batches(words).combine_chunks()
                tree = Tree(held["word"].to_pylist(), some.column("size")[0].as_py())
            by, of = tree.near(some.column("word").to_pylist())
            if len(by):
                yield {
                    "word": some.column("word").take(pa.array(by)), "near": held["word"].combine_chunks().take(pa.array(of)),
                    "n": some.column("n").take(pa.array(by)), "near_n": held["n"].combine_chunks().take(pa.array(of)),
                }


class Tree:
    """A k-d tree over the letter counts of words of one length, searched by many words at once."""

    def __init__(self, words: list[str], size: int):
        self.size = size
        self.codes = coded(words, size)
        self.alphabet = np.unique(self.codes)
        counts, _ = self.counted(self.codes)
        self.counts = counts.astype(np.float32)
        self.norms = (self.counts**2).sum(1)
        self.root = self.grown(np.arange(len(words)))

    def counted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the letters of the tree, a row per word, and how many letters of a word are others."""
        size = len(self.alphabet)
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(size - 1, 0))
        letter = np.where(self.alphabet[at] == codes, at, size) if size else at
        flat = (np.arange(len(codes))[:, None] * (size + 1) + letter).ravel()
        table = np.bincount(flat, minlength=len(codes) * (size + 1)).reshape(len(codes), size + 1)
        return table[:, :size].astype(np.int32), table[:, size]

    def grown(self, members: np.ndarray):
        """A leaf of word numbers, or a cut with its two sides."""
        counts = self.counts[members]
        if len(members) > LEAF and (counts.min(0) < counts.max(0)).any():
            # Nearly all counts are 0 or 1: the letter and count that part the words most evenly.
            best = None
            for least in range(1, int(counts.max()) + 1):
                share = (counts >= least).sum(0)
                off = np.abs(2 * share - len(members))
                off[(share == 0) | (share == len(members))] = 2 * len(members)
                place = int(off.argmin())
                if best is None or off[place] < best[0]:
                    best = int(off[place]), place, least
            _, place, least = best
            above = counts[:, place] >= least
            return place, least, self.grown(members[~above]), self.grown(members[above])
        return (members,)

    def near(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words asked and of the tree of all pairs one edit apart; ``asked`` are as long as the words or one shorter."""
        lengths = np.array([len(word) for word in asked])
        found = [self.near_alike(np.flatnonzero(lengths == n), [word for word in asked if len(word) == n], n) for n in (self.size, self.size - 1)]
        return tuple(np.concatenate(side) for side in zip(*found, strict=True))

    def near_alike(self, who: np.ndarray, asked: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of one length, whose numbers are ``who``."""
        codes = coded(asked, length)
        whole, strange = self.counted(codes)
        # A letter that the tree doesn't know is one down already.
        spare = (1 if length == self.size else 0) - strange
        alive = np.flatnonzero(spare >= 0)
        counts = whole.astype(np.float32)
        norms = (counts**2).sum(1) + strange
        apart = 2 if length == self.size else 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(self.root, alive, np.ones(len(alive), np.int32), spare[alive].astype(np.int32))] if len(alive) else []
        while stack:
            node, some, up, down = stack.pop()
            if len(node) == 4:
                place, least, below, above = node
                here = whole[some, place]
                # What is left of the way to the box of each side.
                less, more = down - np.maximum(here - least + 1, 0), up - np.maximum(least - here, 0)
                for side, keep, ups, downs in ((below, less >= 0, up, less), (above, more >= 0, more, down)):
                    if keep.any():
                        stack.append((side, some[keep], ups[keep], downs[keep]))
                continue
            (members,) = node
            for start in range(0, len(members), BLOCK):
                those = members[start : start + BLOCK]
                for begin in range(0, len(some), BLOCK):
                    mine = some[begin : begin + BLOCK]
                    # Squares of whole numbers, exact in floats: one count up and one down, or one up, are 2 or 1 apart.
                    squares = norms[mine, None] + self.norms[those] - 2 * (counts[mine] @ self.counts[those].T)
                    a, b = np.nonzero(squares == apart)
                    if len(a):
                        kept = self.one_edit(codes[mine[a]], self.codes[those[b]])
                        found.append((who[mine[a[kept]]], those[b[kept]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def one_edit(self, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Whether all letters but one stand in the same order, row by row."""
        if mine.shape[1] == theirs.shape[1]:
            return (mine != theirs).sum(1) == 1
        # The equal letters from the front and those from the back cover the shorter word.
        front = np.cumprod(mine == theirs[:, :-1], 1).sum(1)
        back = np.cumprod((mine == theirs[:, 1:])[:, ::-1], 1).sum(1)
        return front + back >= mine.shape[1]


def coded(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), max(length, 0))


def spelling_variants(words: DataFrame) -> DataFrame:
    """Each of the distinct ``words`` (with its ``n``) with its ``form``, ``root``, ``n_near`` and ``form_n``.

    ``form`` is the near word of largest ``n``, the smallest in code-point order among equals, if that n is at least ``FACTOR`` times the word's; else
    null. ``root`` is the end of the chain of forms, the word itself without one. ``n_near`` counts near words. No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words)
    first = F.min_by(F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n")), F.struct(-F.col("near_n"), F.col("near")))
    grouped = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.any_value("n").alias("n"), first.alias("best"))
    enough = F.col("best.form_n") >= FACTOR * F.col("n")
    chosen = grouped.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, F.col("best.form_n")).alias("form_n"))
    chosen = stored(chosen, "forms")

    # Each link multiplies n by FACTOR or more, so chains are short; every round doubles what is followed.
    links = chosen.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        links = stored(links, "roots")
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        if links.join(onward, links["root"] == onward["via"], "left_semi").isEmpty():
            break
        links = links.join(onward, links["root"] == onward["via"], "left").select("word", F.coalesce("further", "root").alias("root"))
    found = words.join(chosen, "word", "left").join(links, "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
