"""Encoding and decoding by a SentencePiece vocabulary of merge type (BPE).

A text's symbols begin as its characters. An agenda holds all adjacent pairs whose join is a piece, best score first and,
among equals, leftmost; the best pair is merged, its new neighbours enter the agenda, until it is empty. What is no piece then
falls back to its UTF-8 bytes. Two characters that stand side by side in no piece are never merged across, so a text is
cut there into words, and each distinct word is merged once per task, together with all
new words of its Arrow batch: a row per word holds its agenda, and in every step each row merges its best pair. What a batch newly merged
is compared with what the sentencepiece library makes of it.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pipelinekit.llm.batches import map_stream

SPACE = "▁"  # fixed value: how a blank is written in pieces
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what an unknown piece decodes to
CACHED_WORDS = 300_000  # of a task; no result depends on it
ROW_LENGTH = 24  # characters of a word that is merged in a row beside others; longer ones have a heap as their agenda
ROWS = 8192
SLICE_ROWS = 2000  # the more texts, the more new words are merged side by side
NEVER = np.float32(np.inf)

Merged = tuple[bytes, bytes]  # ids as int32, decoded UTF-8


class Vocabulary:
    """The pieces of a model, their scores and kinds; ``model`` is the content of its file."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.library = library
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.hidden = {i for i in range(size) if library.is_control(i)}
        self.unknown = library.unk_id()
        self.bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if library.is_byte(i)}
        self.byte_ids = {byte: i for i, byte in self.bytes_of.items()}
        usual = [i for i in range(size) if i not in self.hidden and i != self.unknown and i not in self.bytes_of]
        if any(library.is_unused(i) for i in usual):
            raise ValueError("a vocabulary with unused pieces is not supported")
        self.ids = {self.pieces[i]: i for i in usual}
        # A higher score goes first; the agenda is a heap with the least in front.
        self.costs = {self.pieces[i]: -library.get_score(i) for i in usual}
        self.shown = {i: self.pieces[i].replace(SPACE, " ") for i in usual} | dict.fromkeys(self.hidden, "") | {self.unknown: UNKNOWN_SURFACE}
        # What two adjacent symbols join to, by their numbers, for rows of words; characters that are no piece have none.
        size = self.size = len(self.pieces)
        joins = {}
        for piece, number in self.ids.items():
            for at in range(1, len(piece)):
                first, second = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if first is not None and second is not None:
                    joins[first * size + second] = number
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[key] for key in self.join_keys.tolist()], np.int32)
        self.cost = np.array([self.costs.get(piece, NEVER) for piece in self.pieces], np.float32)
        # Characters of no piece merge with nothing: a text is cut around them as well.
        known = {character for piece in self.ids for character in piece} - {SPACE}
        self.numbers = np.full(0x110000, -1, np.int32)
        singles = [character for character in known | {SPACE} if character in self.ids]
        self.numbers[[ord(character) for character in singles]] = [self.ids[character] for character in singles]
        self.whole = known <= set(singles)
        self.breaking = next((character for character in "\n\t\u0000" if character not in known), None)
        self.words = re.compile(self.cuts(known) if self.breaking is not None else "(?s:.+)")
        self.merged: dict[str, Merged] = {}
        # The library on the same probes: models with other normalisation or of another type are refused, not misread.
        for probe in ("a", " a  b ", "ﬁ ½　x\n", "abracadabra the cat", "\U0001f600\u0000"):
            if self.encode(probe) != library.encode(probe):
                raise ValueError("only merge-type models with identity normalisation and a leading blank are supported")

    def cuts(self, known: set[str]) -> str:
        """A pattern of the parts of a text that nothing merges across: characters that stand side by side in some piece belong together,
        as do all that are linked by such pairs. A boundary goes with what follows it, unless some piece has one inside."""
        owner = {character: character for character in known}

        def root(character: str) -> str:
            while owner[character] != character:
                owner[character] = character = owner[owner[character]]
            return character

        for piece in self.ids:
            bare = piece.lstrip(SPACE)
            if SPACE in bare:
                return "(?s:.+)"
            for first, second in zip(bare, bare[1:], strict=False):
                owner[root(first)] = root(second)
        groups = defaultdict(list)
        for character in known:
            groups[root(character)].append(character)
        runs = sorted((sorted(group) for group in groups.values() if len(group) > 1), key=len, reverse=True)
        alone = sorted(group[0] for group in groups.values() if len(group) == 1)
        kinds = [f"[{''.join(map(re.escape, run))}]+" for run in runs] + ([f"[{''.join(map(re.escape, alone))}]"] if alone else [])
        return f"{SPACE}*(?:{'|'.join(kinds)})|{SPACE}+|(?s:.)"

    def merge(self, word: str) -> list[int]:
        """The ids of a normalised text, by the agenda of its adjacent pairs."""
        cost_of, push, pop = self.costs.get, heapq.heappush, heapq.heappop
        size = len(word)
        # A symbol lies from its place to ``right`` of it, where the next one begins; a symbol merged into another has none.
        left, right = list(range(-1, size)), list(range(1, size + 1))
        agenda = []
        for at in range(size - 1):
            cost = cost_of(word[at : at + 2])
            if cost is not None:
                agenda.append((cost, at, at + 1, at + 2))
        heapq.heapify(agenda)
        while agenda:
            _, first, second, end = pop(agenda)
            if right[first] != second or right[second] != end:
                continue  # one of the two has been merged since
            right[first], right[second] = end, -1
            if end < size:
                left[end] = first
                cost = cost_of(word[first : right[end]])
                if cost is not None:
                    push(agenda, (cost, first, end, right[end]))
            before = left[first]
            if before >= 0:
                cost = cost_of(word[before:end])
                if cost is not None:
                    push(agenda, (cost, before, first, end))
        found, at = [], 0
        while at < size:
            symbol = word[at : right[at]]
            at = right[at]
            number = self.ids.get(symbol)
            if number is not None:
                found.append(number)
            elif self.byte_ids:
                found.extend(self.byte_ids[byte] for byte in symbol.encode())
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found

    def joined(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that pairs of numbers join to and its cost, which is infinite without one."""
        keys = first.astype(np.int64) * self.size + second
        at = np.minimum(np.searchsorted(self.join_keys, keys), len(self.join_keys) - 1)
        there = (self.join_keys[at] == keys) & (first >= 0) & (second >= 0)
        number = np.where(there, self.join_ids[at], -1)
        return number, np.where(there, self.cost[number], NEVER)

    def merge_rows(self, words: list[str]) -> list[list[int]]:
        """The ids of words of known characters, all of one length: a row for each, whose agenda are the costs of its adjacent pairs."""
        count, width = len(words), len(words[0])
        symbols = self.numbers[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(count, width)
        lengths, places = np.full(count, width), np.arange(width)
        into, costs = self.joined(symbols[:, :-1], symbols[:, 1:])
        alive = np.arange(count)
        while len(alive) and width > 1:
            # The first of the least costs is the leftmost.
            at = costs[alive].argmin(1)
            going = costs[alive, at] < NEVER
            alive, at = alive[going], at[going]
            if not len(alive):
                break
            # The pair becomes its piece, all behind it moves up, and its neighbours form new pairs.
            merged = into[alive, at]
            rows = np.take_along_axis(symbols[alive], np.minimum(places + (places > at[:, None]), width - 1), 1)
            rows[np.arange(len(alive)), at] = merged
            lengths[alive] -= 1
            rows[places >= lengths[alive, None]] = -1
            symbols[alive] = rows
            shift = np.minimum(places[:-1] + (places[:-1] > at[:, None]), width - 2)
            some_into, some_costs = np.take_along_axis(into[alive], shift, 1), np.take_along_axis(costs[alive], shift, 1)
            each = np.arange(len(alive))
            for left in (at - 1, at):
                inside = (left >= 0) & (left < width - 1)
                who, left = each[inside], left[inside]
                some_into[who, left], some_costs[who, left] = self.joined(rows[who, left], rows[who, left + 1])
            some_costs[places[:-1] >= lengths[alive, None] - 1] = NEVER
            into[alive], costs[alive] = some_into, some_costs
        return [row[:length] for row, length in zip(symbols.tolist(), lengths.tolist(), strict=True)]

    def learn(self, words: list[str], checked: bool) -> None:
        """Merge words that are not in the cache of the task, and compare them with the library's."""
        by_length, ids_of, spelled = defaultdict(list), {}, {}
        for word in words:
            by_length[len(word)].append(word)
        for length, same in by_length.items():
            if length == 1 or length > ROW_LENGTH or not self.whole:
                ids_of |= {word: self.merge(word) for word in same}
                continue
            for start in range(0, len(same), ROWS):
                some = same[start : start + ROWS]
                spelled |= zip(some, self.merge_rows(some), strict=True)
        # Known characters merge into pieces that spell the word; others may be bytes.
        self.merged |= {word: (array("i", ids).tobytes(), word.replace(SPACE, " ").encode()) for word, ids in spelled.items()}
        if checked and self.breaking:
            # The library puts a boundary before what it is given: a word has its own, or follows what merges with nothing.
            before = self.library.encode(self.breaking)
            bounded = [word for word in words if word[0] == SPACE and len(word) > 1]
            others = [word for word in words if word[0] != SPACE]
            asked = [word[1:].replace(SPACE, " ") for word in bounded] + [self.breaking + word for word in others]
            wanted = self.library.encode(asked, num_threads=1)
            found = ids_of | spelled
            mine = [found[word] for word in bounded] + [before + found[word] for word in others]
            if wanted != mine:
                raise AssertionError("ids differ from those of the sentencepiece library")
        shown = self.shown.get
        for word, ids in ids_of.items():
            texts = [shown(i) for i in ids]
            text = self.surface(ids) if None in texts else "".join(texts).encode()
            self.merged[word] = array("i", ids).tobytes(), text

    def parts(self, texts: list[str], checked: bool = False) -> list[list[Merged]]:
        """The merged words of whole texts."""
        split = [self.words.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        if len(self.merged) > CACHED_WORDS:
            self.merged.clear()
        new = set().union(*split) - self.merged.keys()
        if new:
            self.learn(list(new), checked)
        return [list(map(self.merged.__getitem__, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(part[0] for part in self.parts([text])[0]), np.int32).tolist()

    def surface(self, ids: list[int]) -> bytes:
        """The text of ids with all its blanks; bytes that are no UTF-8 become U+FFFD, one for each."""
        shown = [self.shown.get(i) for i in ids]
        found, run = [], bytearray()

        def close() -> None:
            rest = bytes(run)
            while rest:
                try:
                    found.append(rest.decode())
                    break
                except UnicodeDecodeError as wrong:
                    found.append(rest[: wrong.start].decode() + "�")
                    rest = rest[wrong.start + 1 :]
            run.clear()

        for number, surface in zip(ids, shown, strict=True):
            if surface is None:
                run.append(self.bytes_of[number])
            else:
                close()
                found.append(surface)
        close()
        return "".join(found).encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids without the blank that encoding put before it."""
        shown = next((i for i in ids if i not in self.hidden), None)
        text = self.surface(ids).decode()
        return text[1:] if shown is not None and self.pieces[shown].startswith(SPACE) else text


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", checked: bool = True) -> DataFrame:
    """``key``, ``ids`` (of the whole text, neither begin nor end) and ``decoded`` (the text of these ids) of every row.

    ``checked`` compares with the sentencepiece library and fails on the first difference: the ids of all new words of a batch and of its first text as a
    whole, and what all its texts decode to.
    A null text is an empty one, which has no ids and decodes to an empty text. Every row gives a row, repeated and
    null keys included; other columns are not read. An empty table gives no rows. A text is handled whole by one task, in time
    n log n of its longest word; rows reach Python in batches of bounded size.
    """
    schema = StructType([
        StructField("key", docs.schema[key].dataType), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType()),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary = Vocabulary(model)
        for part in parts:
            texts = [text or "" for text in part.column(1).to_pylist()]
            merged = vocabulary.parts(texts, checked)
            ids = [b"".join([word[0] for word in words]) for words in merged]
            counts = [len(some) // 4 for some in ids]
            numbers = np.frombuffer(b"".join(ids), np.int32)
            # Every text begins with the blank put before it.
            decoded = [b"".join([word[1] for word in words])[1:].decode() for words in merged]
            if checked and texts:
                each = [part.tolist() for part in np.split(numbers, np.cumsum(counts)[:-1])]
                if vocabulary.library.decode(each) != decoded:
                    raise AssertionError("a decoded text differs from that of the sentencepiece library")
                if vocabulary.library.encode(texts[0]) != each[0]:
                    raise AssertionError("ids of a whole text differ from those of the sentencepiece library")
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield {"key": part.column(0), "ids": pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())), "decoded": decoded}

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_stream(rows, run, schema, SLICE_ROWS).withColumnRenamed("key", key)
