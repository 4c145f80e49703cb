"""Packing documents into training sequences as a cutting-stock problem.

A document's tokens are cut into full sequences and a rest.  The histogram of rest lengths
(fewer classes than a sequence has tokens, whatever the corpus) goes to the driver, where
column generation solves the linear program over patterns of lengths: a knapsack dynamic
program prices new patterns against the duals.  Patterns are rounded down; documents get
their place in a pattern from their rank in their length class, that tasks work out from
counts for each partition.  The rests that rounding leaves, and those of wasteful patterns,
are laid end to end and cut where sequences end; the last tokens fill powers of two.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _kit
from tidemark.llm.token_counts import encoded, encoder, library, special

#: A pattern is used if it leaves no more than this share of a sequence empty.
MOST_WASTE = 0.004
FULL = 1 << 62  # sequence ids of whole sequences from one document start here


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that items, any number of each, are worth in a capacity; and their numbers."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            worth = best[room - sizes[: fits[room]]] + values[: fits[room]]
            i = int(worth.argmax())
            if worth[i] > best[room]:
                best[room], taken[room] = worth[i], i
    copies, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            copies[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), copies


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.004, most: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, in fractions, so that all of the
    demand is cut from the fewest sequences; ends within ``gap`` of the bound by the duals, or
    after ``most`` columns.  It starts from pairs of lengths that fill a sequence together."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / basis.diagonal())
    place = {int(x): i for i, x in enumerate(sizes)}
    for size, i in place.items():
        j = place.get(capacity - size)
        if j is not None and i < j:
            less, more = (i, j) if demand[i] <= demand[j] else (j, i)
            # the pair takes the place of the scarcer length's own pattern
            basis[less, less] = basis[more, less] = 1
            inverse[less, less], inverse[more, less] = 1, -inverse[more, more]
    used = (inverse * demand).sum(1)
    for _ in range(most):
        duals = inverse.sum(0)
        worth, column = knapsack(sizes, duals, capacity)
        if worth <= 1 + 1e-9 or used.sum() <= (1 + gap) * (duals @ demand) / worth:
            break
        some = np.flatnonzero(column)
        step = (inverse[:, some] * column[some]).sum(1)
        up = np.flatnonzero(step > 1e-9)
        i = up[np.argmin(used[up] / step[up])]
        amount = used[i] / step[i]
        used -= amount * step
        used[i] = amount
        pivot = inverse[i] / step[i]
        moved = np.flatnonzero(np.abs(step) > 1e-12)
        inverse[moved] -= np.outer(step[moved], pivot)
        inverse[i] = pivot
        basis[:, i] = column
    return basis, np.maximum(used, 0)


class Plan:
    """Where the rest of a document goes, by its length and its rank among the rests of that length."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        sizes = np.array(sorted(histogram), np.int64)
        left = np.array([histogram[int(x)] for x in sizes], np.int64)
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {int(x): [] for x in sizes}
        self.sequences = 0
        if len(sizes):
            patterns, used = column_generation(sizes, left.astype(float), capacity)
            taken = np.zeros(len(sizes), np.int64)
            for k in np.argsort(-used, kind="stable").tolist():
                copies = patterns[:, k].astype(np.int64)
                times = int(np.ceil(used[k] - 1e-9))
                if times and copies.any() and capacity - int(copies @ sizes) <= MOST_WASTE * capacity:
                    times = min(times, int(((left - taken)[copies > 0] // copies[copies > 0]).min()))
                    at = 0
                    for i in np.flatnonzero(copies).tolist() if times else []:
                        # ranks from taken on, each sequence takes as many as the pattern has copies
                        self.slots[int(sizes[i])].append((int(taken[i]), int(copies[i]), self.sequences, at))
                        at += int(copies[i] * sizes[i])
                        taken[i] += times * copies[i]
                    self.sequences += times
            self.done = {int(x): int(t) for x, t in zip(sizes, taken, strict=True)}
            rest = (left - taken) * sizes
            self.stream = {int(x): int(a) for x, a in zip(sizes, np.cumsum(rest) - rest, strict=True)}
            total = int(rest.sum())
        else:
            self.done, self.stream, total = {}, {}, 0
        whole, over = divmod(total, capacity)
        # the last tokens of the stream fill one sequence for each binary digit of their number
        self.tail = [whole * capacity]
        for bit in reversed(range(over.bit_length())):
            if over >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))

    def place(self, size: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of each piece of the rest."""
        if rank < self.done[size]:
            slots = self.slots[size]
            first, copies, sequence, at = slots[bisect.bisect_right(slots, rank, key=lambda x: x[0]) - 1]
            n, i = divmod(rank - first, copies)
            return [(sequence + n, at + i * size, size)]
        out, at = [], self.stream[size] + (rank - self.done[size]) * size
        end = at + size
        while at < end:
            if at < self.tail[0]:
                n, offset = divmod(at, self.capacity)
                stop = (n + 1) * self.capacity
            else:
                i = bisect.bisect_right(self.tail, at) - 1
                n, offset, stop = self.tail[0] // self.capacity + i, at - self.tail[i], self.tail[i + 1]
            length = min(end, stop) - at
            out.append((self.sequences + n, offset, length))
            at += length
        return out


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(id, tokens, size, part, rank, whole, ids): a row's ids as packed bytes, and of its rest the
    length and the rank in its partition; whole counts the partition's full sequences before it."""
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))

    def made(batches):
        enc, mark, part, seen, whole = encoder(path), special(path), TaskContext.get().partitionId(), {}, 0
        kind = "<u2" if library(path).n_vocab < 1 << 16 else "<u4"
        for batch in batches:
            for row, end, ids, count in encoded(batch["text"], enc, mark):
                at, out, out_ids = 0, [], []
                for n in count.tolist():
                    tokens, size = n + 1, (n + 1) % capacity
                    out.append((tokens, size, part, seen.get(size, 0), whole))
                    seen[size] = seen.get(size, 0) + 1
                    whole += tokens // capacity
                    out_ids.append(np.append(ids[at : at + n], end_id).astype(kind).tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays([batch["id"].slice(row, end - row), *(pa.array([x[i] for x in out], pa.int64()) for i in range(5)), pa.array(out_ids, pa.binary())], ["id", "tokens", "size", "part", "rank", "whole", "ids"])

    return source.mapInArrow(made, f"id {source.schema['id'].dataType.simpleString()}, tokens long, size long, part long, rank long, whole long, ids binary")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian unsigned 32-bit, as bytes),
    doc_tokens, sequence_id, offset.

    A row's ids are those of its text and then end_id; a null or empty text is end_id alone.
    Each id lies in exactly one piece; a sequence's pieces fill it from 0 without gaps.  Null
    and repeated ids are documents of their own.  Other columns are ignored; an empty table
    gives an empty result.
    """
    made = _kit.written(tokenized(docs, path, id_col, text_col, capacity, end_id), "tokens")
    counts = made.where("size > 0").groupBy("part", "size").agg(F.count("*").alias("n"))
    histogram = {x["size"]: x["n"] for x in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # fewer rows than capacity
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, capacity))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kind = made.schema["id"].dataType.simpleString()
    wide = "<u2" if library(path).n_vocab < 1 << 16 else "<u4"
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        places = plan.value
        for batch in batches:
            kinds[0] = batch.schema.field("id").type
            out, held = [[] for _ in names], 0
            for doc, tokens, size, part, rank, whole, ids, ahead in zip(*(batch[x].to_pylist() for x in ("id", "tokens", "size", "part", "rank", "whole", "ids", "before")), strict=True):
                ids = np.frombuffer(ids, wide).astype("<u4")
                pieces = [(FULL + (part << 36) + whole + i, 0, capacity) for i in range(tokens // capacity)]
                if size:
                    pieces += places.place(size, (ahead or 0) + rank)
                start = 0
                for sequence, offset, length in pieces:
                    for x, y in zip(out, (doc, start, length, ids[start : start + length].tobytes(), tokens, sequence, offset), strict=True):
                        x.append(y)
                    start += length
                held += start
                if held > _kit.SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    done = made.join(ranked, ["part", "size"], "left").mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return done.withColumnRenamed("id", id_col)
