"""Token counts and ids of a byte-level BPE, by table lookup of pre-tokens.

Texts are split into pre-tokens with array operations on their code points.  A pre-token is
looked up by a pair of 64-bit hashes first in a broadcast table of frequent ones, then in a
cache of the worker; a hit needs both hashes.  What both miss is encoded by the library, once,
and enters the cache.  Pre-tokens are never shuffled.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit

LETTER, NUMBER, OTHER, BLANK, SPACE, UNKNOWN = range(6)
END = "<|endoftext|>"


class Splitter:
    """Classes of code points, as the library's own pre-tokenizer tells them; asked for when first met."""

    def __init__(self, path: str) -> None:
        self.pieces, self.kinds = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
        self.kinds[32] = SPACE

    def classes(self, code: np.ndarray) -> np.ndarray:
        out = self.kinds[code]
        if (out == UNKNOWN).any():
            for c in np.unique(code[out == UNKNOWN]).tolist():
                # a character of a known class and this one are one pre-token if they are of one class
                self.kinds[c] = next((kind for kind, known in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.pieces(known + chr(c))) == 1), BLANK)
            out = self.kinds[code]
        return out


def pre_tokens(data: np.ndarray, offs: np.ndarray, splitter: Splitter) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens start, and where each row's begin among them (rows + 1).

    A run of letters, of numbers or of other characters takes one space before it along.
    White space leaves its last character to what follows: a space joins it, another stands
    alone.  An apostrophe that begins a pre-token joins s, t, m, d, re, ve or ll.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # first byte of each character
    code = data[at].astype(np.uint32)
    size = np.diff(at, append=len(data))
    for n, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        wide = np.flatnonzero(size == n)
        if len(wide):
            value = code[wide] & keep
            for i in range(1, n):
                value = (value << 6) | (data[at[wide] + i] & 0x3F)
            code[wide] = value
    kind = splitter.classes(code)
    blank = kind >= BLANK
    row_first = np.searchsorted(at, offs[:-1][offs[1:] > offs[:-1]])
    starts_row = np.zeros(len(at), bool)
    starts_row[row_first] = True
    ends_row = np.zeros(len(at), bool)
    ends_row[row_first[1:] - 1] = True
    ends_row[-1] = True
    before = np.r_[np.uint8(255), kind[:-1]]
    blank_before = np.r_[False, blank[:-1]] & ~starts_row
    first = (kind != before) & ~(blank & blank_before)  # a run of one class begins
    first |= starts_row
    # the last blank before a character that is not blank parts from its run; a space takes that character along
    parting = blank & ~ends_row & ~np.r_[blank[1:], False]
    first |= parting
    joined = np.zeros(len(at), bool)
    spot = np.flatnonzero(parting & (kind == SPACE))
    joined[spot + 1] = True
    first &= ~joined
    quotes = np.flatnonzero(first & (code == 0x27) & ~ends_row)
    if len(quotes):
        room = np.r_[code, np.zeros(2, np.uint32)]
        edge = np.r_[starts_row, True, True]
        a, b = room[quotes + 1], room[quotes + 2]
        two = ~edge[quotes + 1] & ~edge[quotes + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        one = ~edge[quotes + 1] & np.isin(a, [ord(x) for x in "stmd"])
        for which, n in ((one, 1), (two, 2)):
            spot = quotes[which]
            for i in range(1, n + 1):
                first[spot + i] = False
            after = spot + n + 1
            after = after[after < len(at)]
            # a letter goes on after the contraction as a pre-token of its own
            first[after[kind[after] == LETTER]] = True
    starts = at[first]
    return starts, np.searchsorted(starts, offs)


class Table:
    """A hash table from pairs of 64-bit hashes to positions, as arrays; lookups take many at once.

    The first hash gives the place, a hit needs both: what shares one hash only is told apart.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.checks, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        left, place, mask = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(left):
            value = self.values[place]
            hit = (self.keys[place] == keys[left]) & (self.checks[place] == checks[left]) & (value >= 0)
            out[left[hit]] = value[hit]
            on = ~hit & (value >= 0)
            left, place = left[on], (place[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        """Add distinct pairs that are not there."""
        mask, left, place = (1 << self.bits) - 1, np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        claimed = np.full(1 << self.bits, -1, np.int64) if len(keys) else None
        while len(left):
            free = self.values[place] < 0
            claimed[place[free]] = left[free]  # of several, the last one has the place
            won = free & (claimed[place] == left)
            at, own = place[won], left[won]
            self.keys[at], self.checks[at], self.values[at] = keys[own], checks[own], values[own]
            left, place = left[~won], (place[~won] + 1) & mask
        self.used += len(keys)


class Encoder:
    """Ids of pre-tokens by hash, with the frequent ones given and the others encoded and cached."""

    ROOM = 20  # bits of the worker cache's table; it is emptied when half full

    def __init__(self, path: str, frequent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.bpe, self.splitter, self.top = library(path), Splitter(path), None
        if frequent is not None:
            self.top = Table(max(8, int(2 * len(frequent[0])).bit_length()))
            self.top.add(*frequent)
        self.clear()

    def clear(self) -> None:
        self.cache, self.pool, self.filled, self.edges = Table(self.ROOM), np.zeros(1 << 20, np.uint32), 0, np.zeros((1 << self.ROOM) + 1, np.int64)

    def _fill(self, keys: np.ndarray, checks: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache places of pairs of hashes, of which the spans are given; encodes what the cache lacks."""
        place = self.cache.find(keys, checks)
        lost = np.flatnonzero(place < 0)
        if not len(lost):
            return place
        where, back = _kit.distinct_pairs(keys[lost], checks[lost])
        if self.cache.used + len(where) > 1 << (self.ROOM - 1):
            self.clear()
            where, back = _kit.distinct_pairs(keys, checks)
            lost = np.arange(len(keys))
            while len(where) > 1 << (self.ROOM - 1):  # one slice may hold more than the cache's share
                self.ROOM += 1
                self.clear()
        first, encode, where = self.cache.used, self.bpe._core_bpe.encode_single_piece, lost[where]
        lists = [encode(data[a:b].tobytes()) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        while self.filled + total > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), np.uint32)]
        self.pool[self.filled : self.filled + total] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, total)
        self.edges[first + 1 : first + 1 + len(lists)] = self.filled + np.cumsum(sizes)
        self.filled += total
        new = np.arange(first, first + len(lists), dtype=np.int32)
        self.cache.add(keys[where], checks[where], new)
        place[lost] = new[back]
        return place

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token."""
        ends = np.r_[starts[1:], len(data)]
        keys, checks = _kit.span_hashes(data, starts, ends, pairs=True)
        out = self.top.find(keys, checks) if self.top else np.full(len(keys), -1, np.int32)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            place = self._fill(keys[lost], checks[lost], data, starts[lost], ends[lost])
            out[lost] = self.edges[place + 1] - self.edges[place]
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each pre-token's."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(data)]
        place = self._fill(*_kit.span_hashes(data, starts, ends, pairs=True), data, starts, ends)
        begin = self.edges[place]
        size = self.edges[place + 1] - begin
        edge = np.cumsum(size) - size
        return self.pool[np.arange(int(size.sum())) + np.repeat(begin - edge, size)], size


@functools.cache
def library(path: str) -> tiktoken.Encoding:
    """The BPE of a tokenizers file (its vocabulary's order is its merges' order)."""
    vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token != END}
    return tiktoken.Encoding("byte-bpe", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


@functools.cache
def special(path: str) -> int:
    """The id of the special string, that the library finds inside texts."""
    return next(x["id"] for x in json.loads(open(path, encoding="utf-8").read())["added_tokens"] if x["content"] == END)


def marked(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Offsets of a text split at the special strings, and where the strings are; None without any."""
    raw, mark, spots, at = data.tobytes(), END.encode(), [], 0
    while (at := raw.find(mark, at)) >= 0:
        end = int(np.searchsorted(offs, at, "right"))
        if end < len(offs) and at + len(mark) <= offs[end]:
            spots.append(at)
            at += len(mark)
        else:  # it passes from one row into the next
            at += 1
    if not spots:
        return None
    spots = np.array(spots, np.int64)
    return np.unique(np.r_[offs, spots, spots + len(mark)]), spots


def _split(data: np.ndarray, offs: np.ndarray, splitter: Splitter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pre_tokens() with each special string as a pre-token, and which these are."""
    found = marked(data, offs)
    if found is None:
        starts, begins = pre_tokens(data, offs, splitter)
        return starts, begins, np.zeros(0, np.int64)
    edges, spots = found
    starts, _ = pre_tokens(data, edges, splitter)
    inside = np.searchsorted(spots, starts, "right") - 1
    keep = (inside < 0) | (starts >= spots[inside] + len(END)) | (starts == spots[inside])
    starts = starts[keep]
    return starts, np.searchsorted(starts, offs), np.searchsorted(starts, spots)


_encoders: dict = {}


def encoder(path: str, key: str = "", frequent=None) -> Encoder:
    """The worker's encoder; it lives as long as the worker does."""
    if (path, key) not in _encoders:
        _encoders.clear()
        _encoders[path, key] = Encoder(path, frequent)
    return _encoders[path, key]


def encoded(column: pa.Array, enc: Encoder, mark: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids of all, ids per row) of the slices of a text column."""
    for row, end, data, offs in _kit.slices(column):
        starts, begins, spots = _split(data, offs, enc.splitter)
        ids, size = enc.ids(data, starts)
        edge = np.r_[0, np.cumsum(size)]
        if len(spots):
            keep = np.ones(len(ids), bool)
            for i in spots.tolist():
                ids[edge[i]] = mark
                keep[edge[i] + 1 : edge[i + 1]] = False
            ids, edge = ids[keep], np.r_[0, np.cumsum(keep)][edge]
        yield row, end, ids, np.diff(edge[begins])


def frequent_lengths(docs: DataFrame, path: str, text_col: str, entries: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of hashes and token counts of the most frequent pre-tokens in a sample of about sample_rows rows.

    The table is a cache: whatever it holds, counts come out the same.  It has ``entries``
    entries at most, 20 bytes each, and the driver gets no more rows than that.  The sample's
    size doesn't depend on the table's, so one task can sort its pre-tokens.
    """

    def tally(batches):
        enc, seen = encoder(path), {}
        for batch in batches:
            for _, _, data, offs in _kit.slices(batch["text"]):
                starts, _, spots = _split(data, offs, enc.splitter)
                starts, ends = np.delete(starts, spots), np.delete(np.r_[starts[1:], len(data)], spots)
                keys, checks = _kit.span_hashes(data, starts, ends, pairs=True)
                if len(keys):
                    first, back = _kit.distinct_pairs(keys, checks)
                    place = enc._fill(keys[first], checks[first], data, starts[first], ends[first])
                    size, n = enc.edges[place + 1] - enc.edges[place], np.bincount(back)
                    for k, c, m, s in zip(keys[first].view(np.int64).tolist(), checks[first].view(np.int64).tolist(), n.tolist(), size.tolist(), strict=True):
                        seen[k, c] = (seen.get((k, c), (0, 0))[0] + m, s)
        best = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((*k, *v) for k, v in best), strict=True) if best else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["k", "c", "n", "tokens"])

    few = docs.select(_kit.text_of(text_col).alias("text")).sample(min(1.0, sample_rows / max(1, docs.count())), seed=7)
    sums = few.mapInArrow(tally, "k long, c long, n long, tokens int").groupBy("k", "c").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
    rows = sums.coalesce(1).orderBy(F.desc("n"), "k", "c").limit(entries).collect()
    return tuple(np.array([x[c] for x in rows], np.int64).view(np.uint64) for c in ("k", "c")) + (np.array([x["tokens"] for x in rows], np.int32),)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, entries: int = 32_768, sample_rows: int = 2_000) -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (more than max_tokens).

    ``path`` is a tokenizers file of a byte-level BPE; special strings inside texts count as
    their one token, as the library has it by default.  A null or empty text has 0 bytes and
    tokens.  A text of any length is one slice of work by itself.  Rows stay as they are: null and repeated ids too.  Other columns are ignored.
    """
    from uuid import uuid4

    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, entries, sample_rows))
    name = uuid4().hex

    def count(batches):
        enc = encoder(path, name, table.value)
        for batch in batches:
            tokens = np.zeros(len(batch), np.int64)
            for row, end, data, offs in _kit.slices(batch["text"]):
                starts, begins, spots = _split(data, offs, enc.splitter)
                if len(starts):
                    n = enc.counts(data, starts).astype(np.int64)
                    n[spots] = 1
                    tokens[row:end] = np.diff(np.r_[0, np.cumsum(n)][begins])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    text = _kit.text_of(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = source.mapInArrow(count, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
