import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, by_repr, rows, table
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from tidemark.llm import packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts(spark, library):
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows()]
    got = token_counts.token_counts(table(spark), PATH, entries=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert by_repr(got) == by_repr(want)


def test_ids_of_odd_texts(library):
    import pyarrow as pa

    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'", "'s", "'re", "'LL", "'t", "1", "²", "é", "漢", "!", "…", " ", "\r", "<|endoftext|>", "<|endoftext|", "　", "\x1c", "\x85", "᠎", "\U0001f600", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}\n{chr(c)}'s" for c in [*range(0, 0x3000, 3), *range(0x1E000, 0x1F000, 7)]]
    enc, at = token_counts.Encoder(PATH), 0
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for row, _, ids, sizes in token_counts.encoded(pa.array(texts), enc, token_counts.special(PATH)):
        at = 0
        for i, n in enumerate(sizes.tolist()):
            assert ids[at : at + n].tolist() == want[row + i], texts[row + i]
            at += n


def test_cache_that_overflows(library):
    import pyarrow as pa

    enc = token_counts.Encoder(PATH)
    enc.ROOM = 4
    enc.clear()
    texts = [f"{i} {i * 7919} {'ab' * (i % 5)}" for i in range(300)]
    got = [n for _, _, _, sizes in token_counts.encoded(pa.array(texts), enc, 50256) for n in sizes.tolist()]
    assert got == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pack(spark, library, capacity):
    done = packing.pack(table(spark), PATH, capacity=capacity).withColumn("crc", F.crc32("ids")).collect()
    want = sorted([[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows()])
    sequences, docs = {}, {}
    for r in done:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.crc == zlib.crc32(r.ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    rebuilt = []
    for (_, n), pieces in docs.items():
        text = [x for _, ids in sorted(pieces) for x in ids]
        rebuilt += [text[i : i + n] for i in range(0, len(text), n)] if len(text) > n else [text]
    assert sum(map(len, rebuilt)) == sum(map(len, want))
    ones = [x for (d, _), p in docs.items() if d not in (3, None) for x in [[y for _, ids in sorted(p) for y in ids]]]
    assert all(x in want for x in ones)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.01 * sum(map(len, want))


def test_plan_places_every_rest_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 5000)
    size, n = np.unique(lengths, return_counts=True)
    plan = packing.Plan(dict(zip(size.tolist(), n.tolist())), 100)
    cells = set()
    for s, m in zip(size.tolist(), n.tolist()):
        for rank in range(m):
            pieces = plan.place(s, rank)
            assert sum(x[2] for x in pieces) == s
            for q, o, k in pieces:
                spots = {(q, o + i) for i in range(k)}
                assert not spots & cells and o + k <= 100
                cells |= spots
    assert len(cells) == lengths.sum()
    assert plan.sequences > 0


def test_knapsack():
    worth, copies = packing.knapsack(np.array([3, 5, 7]), np.array([0.3, 0.55, 0.7]), 13)
    assert worth == pytest.approx(1.4) and copies @ np.array([3, 5, 7]) <= 13


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(empty, PATH).count() == 0
    assert packing.pack(empty, PATH).count() == 0
