"""Ranked lexical search by WAND over document shards.

One pass over the texts counts terms; of each document the query's terms are kept with their
frequencies, written as a table.  From it come the statistics of the whole corpus.  A second pass
cuts each task's documents into shards.  In a shard a term has a list of documents and impacts
and its largest impact.  Documents are walked in order of their ids, a run of them at a time: the
terms whose largest impacts together cannot beat the heap's threshold are never walked, only
looked up; a document is a pivot, and is scored, only if the largest impacts of the terms it holds
can.  The shards' heaps are merged by a window that ranks within each task first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _kit
from tidemark.llm.minhash import lowered

#: Documents, and postings, after which a shard ends; documents in a run that is walked at once.
SHARD, POSTINGS, RUN = 32_768, 4_000_000, 4_096
#: Terms of the queries that go through the corpus together; one query's terms are never parted.
BLOCK = 200_000
#: The scale of impacts, and the parameters of the lengths' influence in hundredths.
SCALE, SLOPE = 1_000_000_000, 90

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


class Queries:
    """A block of queries: the distinct terms' hashes, sorted by the first, and each query's terms among them."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]]):
        first, check = (np.concatenate([x[i] for x in items] + [np.zeros(0, np.uint64)]) for i in (1, 2))
        order = np.lexsort((check, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (check[order][1:] != check[order][:-1])
        self.first, self.check = first[order][new], check[order][new]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        ends = np.cumsum([len(x[1]) for x in items])
        self.items = [(x[0], np.unique(number[e - len(x[1]) : e])) for x, e in zip(items, ends, strict=True)]
        #: Hashes that two different terms share are told apart by the second.
        self.twins = np.flatnonzero(self.first[1:] == self.first[:-1]) if len(self.first) else np.zeros(0, np.int64)

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms): which of the spans are terms of the queries."""
        if not len(self.first) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _kit.span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == h)
        first, check = _kit.span_hashes(data, starts[hit], ends[hit], pairs=True)
        at = at[hit]
        for _ in range(len(self.twins)):  # almost never entered
            at = np.where((self.check[at] != check) & (at + 1 < len(self.first)) & (self.first[np.minimum(at + 1, len(self.first) - 1)] == first), at + 1, at)
        right = (self.first[at] == first) & (self.check[at] == check)
        return hit[right], at[right]


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms, and where each row's begin; a term is a run of letters and digits
    of ASCII and of any characters beyond it."""
    return _kit.words(data, offs, _TERM)


def blocks(queries: DataFrame, id_col: str, text_col: str, most: int = BLOCK) -> Iterator[tuple[list, Queries]]:
    """The queries' rows in blocks of about ``most`` terms, with their ids; the driver holds a block at a time."""
    ids, items, size = [], [], 0
    for row in queries.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text")).toLocalIterator():
        data = lowered(np.frombuffer(row["text"].encode(), np.uint8))
        starts, ends, _ = terms(data, np.array([0, len(data)]))
        first, check = _kit.span_hashes(data, starts, ends, pairs=True)
        at, _ = _kit.distinct_pairs(first, check) if len(first) else (np.zeros(0, np.int64), None)
        items.append((len(ids), first[at], check[at]))
        ids.append(row["id"])
        size += len(at) + 1
        if size >= most:
            yield ids, Queries(items)
            ids, items, size = [], [], 0
    if ids:
        yield ids, Queries(items)


def postings(docs: DataFrame, asked: Queries, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: all its terms' number, and those asked for with their frequencies."""
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(asked)  # about ``BLOCK`` terms of 16 bytes

    def count(batches):
        asked = sent.value
        for batch in batches:
            for row, end, data, offs in _kit.slices(batch["text"]):
                data = lowered(data)
                starts, ends, begins = terms(data, offs)
                n = np.diff(begins)
                at, term = asked.found(data, starts, ends)
                pair, tf = np.unique((np.searchsorted(begins, at, "right") - 1) * np.int64(len(asked.first) + 1) + term, return_counts=True)
                owner, term = np.divmod(pair, np.int64(len(asked.first) + 1))
                per = np.bincount(owner, minlength=end - row)
                made = pa.RecordBatch.from_arrays([batch["id"].slice(row, end - row), pa.array(n.astype(np.int64)), _kit.ragged(term.astype(np.int32), per, pa.int32()), _kit.ragged(tf.astype(np.int32), per, pa.int32())], ["id", "n", "terms", "tfs"])
                yield made.filter(pa.array(n > 0))

    return source.mapInArrow(count, f"id {source.schema['id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) for each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L of documents of n terms, exact at any size."""
    if len(n) and SLOPE * int(n.max()) * documents >= 1 << 62:
        return np.array([100 - SLOPE + SLOPE * x * documents // total for x in n.tolist()], np.int64)
    return 100 - SLOPE + SLOPE * n * documents // max(total, 1)


class Shard:
    """Documents in the order of their ids, and for each term its documents, impacts and largest impact."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, total: int):
        m = lengths(n, documents, total)
        tf = tf.astype(np.int64)
        impact = weight[term] * ((SCALE * tf) // (1000 * tf + 8 * m[owner]))
        order = np.argsort(term, kind="stable")  # owners ascend within a term
        self.doc, self.impact = owner[order], impact[order]
        self.begins = np.searchsorted(term[order], np.arange(len(weight) + 1))
        full = np.flatnonzero(np.diff(self.begins))
        self.most = np.zeros(len(weight), np.int64)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impact, self.begins[full])
        self.size = len(n)

    def looked_up(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The impacts of a term in documents; 0 where it isn't."""
        own = self.doc[self.begins[term] : self.begins[term + 1]]
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, self.impact[self.begins[term] + at], 0)

    def scored(self, asked: list[int], docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t in asked:
            out += self.looked_up(t, docs)
        return out

    def top(self, asked: np.ndarray, k: int, run: int = RUN) -> list[tuple[int, int]]:
        """The k best (score, document) of those with a score above 0; of equal scores the first documents."""
        asked = asked[self.most[asked] > 0]
        asked = asked[np.argsort(-self.most[asked], kind="stable")].tolist()
        most = self.most[asked]
        rest = np.r_[np.cumsum(most[::-1])[::-1], 0]  # what the terms from one on can add
        heap: list[tuple[int, int]] = []  # of (score, -document)
        # documents of the heaviest terms give a threshold to start from; they are met again in their turn
        start, seen = [], 0
        for t in asked:
            start.append(self.doc[self.begins[t] : self.begins[t + 1]][:run])
            seen += len(start[-1])
            if seen >= 4 * k:
                break
        known = self.scored(asked, np.unique(np.concatenate(start))) if start else np.zeros(0, np.int64)
        least = int(np.partition(known, -k)[-k]) - 1 if len(known) >= k else 0  # scores up to it are not among the best
        low = 0
        while asked and low < self.size:
            walked = max(1, int(np.searchsorted(-rest, -least)))  # terms beyond can't beat the threshold by themselves
            walked = min(walked, len(asked))
            high = min(self.size, low + run)
            bound = np.zeros(high - low, np.int64)
            for i, t in enumerate(asked[:walked]):
                a, b = self.begins[t], self.begins[t + 1]
                a, b = a + np.searchsorted(self.doc[a:b], low), a + np.searchsorted(self.doc[a:b], high)
                bound[self.doc[a:b] - low] += most[i]
            pivots = np.flatnonzero(bound + rest[walked] > least)
            pivots = pivots[bound[pivots] > 0] + low
            for i in range(walked, len(asked)):  # lists that are only looked up, while the bound still can beat the threshold
                if not len(pivots):
                    break
                held = self.looked_up(asked[i], pivots) > 0
                bound[pivots[held] - low] += most[i]
                pivots = pivots[bound[pivots - low] + rest[i + 1] > least]
            if len(pivots):
                for score, doc in zip(self.scored(asked, pivots).tolist(), pivots.tolist(), strict=True):
                    if score > least:
                        (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, (score, -doc))
                        if len(heap) == k:
                            least = max(least, heap[0][0])
            low = high
        return [(s, -d) for s, d in heap]


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """The k documents of the highest scores above 0 for each row of queries: query_col, rank from 1, id_col, score.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z lowered.  The score
    is that of the contract, in whole numbers; of equal scores the smaller id comes first, ids
    that are null last.  A null text, of a document or a query, has no terms: such a document
    counts in no statistic, such a query has no rows, nor has one whose terms are in no document.
    Rows of queries that repeat an id are each ranked; rows of documents that repeat an id are
    documents each.  Texts may be of any length; other columns are ignored; empty tables give
    an empty result.  The corpus is gone through once for every ``BLOCK`` of the queries' terms.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    query_kind = queries.schema[query_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{query_col} {query_kind}, rank int, {id_col} {kind}, score long")
    for ids, asked in blocks(queries, query_col, query_text_col):
        held = _kit.written(postings(docs, asked, id_col, text_col), "postings")
        documents, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(asked.first), np.int64)
        for term, n in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # a row for each of the block's terms
            df[term] = n
        heaps = _kit.written(_heaps(held, asked, weights(df, documents), documents, total, k, kind), "heaps")
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        best = heaps.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, {query_col} {query_kind}")
        out = out.union(best.join(names, "item").select(query_col, "rank", F.col("id").alias(id_col), "score"))
        _kit.dropped(held)
    return out


def _heaps(held: DataFrame, asked: Queries, weight: np.ndarray, documents: int, total: int, k: int, kind: str) -> DataFrame:
    """(item, id, score): each shard's best documents of each query."""
    sent = held.sparkSession.sparkContext.broadcast((asked.items, weight))

    def search(batches):
        items, weight = sent.value
        waiting, size, hits = [], 0, 0

        def shard():
            table = pa.Table.from_batches(waiting).combine_chunks()
            table = table.take(pa.compute.sort_indices(table["id"], null_placement="at_end"))
            per = pa.compute.list_value_length(table["terms"]).to_numpy()
            flat = lambda c: pa.compute.list_flatten(table[c]).to_numpy()
            own = Shard(table["n"].to_numpy(), np.repeat(np.arange(len(per)), per), flat("terms"), flat("tfs"), weight, documents, total)
            found = [(item, d, s) for item, terms in items for s, d in own.top(terms, k, RUN)]
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), table["id"].combine_chunks().take(pa.array([f[1] for f in found], pa.int64())), pa.array([f[2] for f in found], pa.int64())],
                ["item", "id", "score"],
            )

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            hits += len(batch["terms"].flatten())
            if size >= SHARD or hits >= POSTINGS:
                yield shard()
                waiting, size, hits = [], 0, 0
        if waiting:
            yield shard()

    return held.mapInArrow(search, f"item int, id {kind}, score long")
