"""Shards and packings against their laws."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pipelinekit.llm.packing import LENGTH, best_fit, crossover, evolve, pack, worth
from pipelinekit.llm.queries import tokenizer_model
from pipelinekit.llm.sharding import byte_shards


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards(documents, texts, shards):
    got = byte_shards(documents, shards).collect()
    sizes = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(sizes)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    total, most = sum(s for _, s, _ in sizes), max(s for _, s, _ in sizes)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / shards) <= most
    # Contiguous: in order of shard and slot the keys rise, nulls first.
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert keys == sorted(keys)


def test_shards_of_nothing_and_of_one_key(nothing, spark):
    assert byte_shards(nothing, 5).count() == 0
    one = spark.range(1000).selectExpr("CAST(1 AS bigint) AS doc_id", "'same' AS text")
    assert Counter(r.shard for r in byte_shards(one, 8).collect()) == dict.fromkeys(range(8), 125)


def test_packing_keeps_every_token(documents, texts):
    tokenizer = Tokenizer.from_str(tokenizer_model())
    want, total = Counter(), 0
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for n, at in enumerate(range(0, len(ids), LENGTH)):
            part = ids[at : at + LENGTH]
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = pack(documents, tokenizer_model()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spots in by.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= LENGTH
    assert len(by) <= -(-total // LENGTH) * 1.05 + 1


def test_special_tokens_are_the_tokenizers(spark):
    """Their strings in a text, in any case and without blanks around them, are what the plain tokenizer makes of them."""
    tokenizer = Tokenizer.from_str(tokenizer_model())
    rows = ["hello <|endoftext|> there", "<|startoftext|>a<|ENDOFTEXT|>b", "<|endoftext|>", "x<|endoftext|", "a b. c, <|endoftext|><|endoftext|>"]
    got = pack(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), tokenizer_model()).collect()
    want = {(i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in enumerate(rows)}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want and len(got) == len(rows)


def test_nothing_to_pack(nothing):
    assert pack(nothing, tokenizer_model()).count() == 0


def test_genetic_steps_keep_pieces_and_gain():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 400).tolist()
    first = best_fit(sorted(range(400), key=lambda i: -sizes[i]), sizes, [], LENGTH)
    other = best_fit(list(range(400)), sizes, [], LENGTH)
    for packing in (first, other, crossover(first, other, sizes, LENGTH, rng), evolve(sizes, [], LENGTH, 0), evolve(sizes, [other], LENGTH, 3)):
        assert sorted(i for _, held in packing for i in held) == list(range(400))
        assert all(room == LENGTH - sum(sizes[i] for i in held) and room >= 0 for room, held in packing)
    assert worth(evolve(sizes, [first, other], LENGTH, 5), LENGTH) >= worth(first, LENGTH)
    assert evolve([], [], LENGTH, 0) == []
