"""Removal of passages that repeat, by super-k-mer partitioning of word windows.

Every window of ``width`` words has a minimiser: the smallest hash among its ``part``-word
sequences, leftmost first.  Consecutive windows with the minimiser at one place are a run
(a super-k-mer).  Equal windows have equal minimisers, so a minimiser of one run alone needs
no more work: only runs of repeated minimisers travel, each as one packed string of words, to
their minimiser's bucket.  There the windows are compared word by word.  Runs of a minimiser
with very many runs are dealt by their windows instead, and a task sends a window of these once
however often it meets it, so a bucket gets no more of a common passage than there are tasks.
Texts that are equal as a whole are one text with a number of copies.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit

HOT = 8192  # runs from which a minimiser's windows are dealt one by one
HELD = 50_000  # such windows that a task remembers at once


def runs(data: np.ndarray, offs: np.ndarray, width: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, minimiser) of each run of windows that share a minimiser's place."""
    starts, ends, begins = _kit.words(data, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(begins))
    window = np.flatnonzero(row[: max(0, len(row) - width + 1)] == row[width - 1 :])
    if not len(window):
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64))
    value = _kit.sequence_hashes(_kit.span_hashes(data, starts, ends), part)
    place, span, most = np.arange(len(value), dtype=np.int32), 1, width - part + 1
    while span < most:
        step = min(span, most - span)
        left = value[:-step] <= value[step:]
        value, place, span = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:]), span + step
    at = place[window]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first = window[new]
    return row[first], first - begins[row[first]], np.diff(np.r_[new, len(window)]), value[first]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text); key is that of the text, 16 bytes of its SHA-256."""
    text = _kit.text_of(text_col)
    # the condition always holds; it is in every plan, so that joins by key share one shuffle of the texts
    return docs.select(F.col(id_col).alias("id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"), text.alias("text")).where("key is not null")


def repeated_spans(texts: DataFrame, copies: DataFrame, width: int = 35, part: int = 6) -> DataFrame:
    """(key, salt, copies, spans) of each text of keyed() that repeats as a whole or has windows that repeat.

    spans are the word ranges [begin, end) that windows found elsewhere, or at another place of
    the text, cover.  copies has (key, copies, low, salts): a text's rows, their smallest id, and
    the salts over which its rows are dealt, which have a row each.
    """

    def light(batches):
        for batch in batches:
            for row, _, data, offs in _kit.slices(batch["text"]):
                r, first, n, value = runs(data, offs, width, part)
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(r + row)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(value.view(np.int64))], ["key", "first", "n", "mini"])

    def packed(batches, held):
        seen: dict[bytes, tuple | bool] = {}  # windows of hot runs: where each was met first, or that it was sent on
        for batch in batches:
            out = [[], [], [], [], []]
            batch = batch.filter(batch["first"])  # as a condition it would part this join's shuffle from the last one's
            for key, body, own in zip(*(batch[x].to_pylist() for x in ("key", "text", "runs")), strict=True):
                word = body.encode().split()
                found = []
                for run in own:
                    if not run["hot"]:
                        found.append((run["first"], run["n"], run["mini"], b" ".join(word[run["first"] : run["first"] + run["n"] + width - 1])))
                        continue
                    if len(seen) > held:
                        seen.clear()
                    for first in range(run["first"], run["first"] + run["n"]):
                        window = b" ".join(word[first : first + width])
                        before = seen.setdefault(window, (key, first))
                        if before == (key, first):  # met for the first time, or a row that repeats
                            found.append((first, 1, xxhash.xxh3_64_intdigest(window) - (1 << 63), window))
                        else:  # it repeats, whatever other tasks hold; what was met first hears of it from here
                            found.append((first, 1, xxhash.xxh3_64_intdigest(key) - (1 << 63), None))
                            if before is not True:
                                found.append((before, 1, xxhash.xxh3_64_intdigest(before[0]) - (1 << 63), None))
                                seen[window] = True
                for first, n, bucket, string in found:
                    whose, first = first if isinstance(first, tuple) else (key, first)
                    for x, y in zip(out, (whose, first, n, bucket, string), strict=True):
                        x.append(y)
                if len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    kinds, names = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], ["key", "first", "n", "bucket", "string"]

    def counted(batches):
        """Reads runs sorted by bucket; a window is told once it has come up at two places."""
        at, seen = None, {}
        for batch in batches:
            out = []
            for key, first, n, bucket, string in zip(*(batch[x].to_pylist() for x in names), strict=True):
                if bucket != at:
                    at, seen = bucket, {}
                if string is None:  # told already
                    out.append((key, first, first + n + width - 1))
                    continue
                edge = [0, *(i + 1 for i, c in enumerate(string) if c == 32), len(string) + 1]
                begin = None
                for i in range(n):
                    window = string[edge[i] : edge[i + width] - 1]
                    before = seen.get(window)
                    if before is None:
                        seen[window] = (key, first + i)
                    elif before is not True:
                        if before == (key, first + i):  # the same place again, of a row that repeats
                            before = None
                        else:
                            out.append((*before, before[1] + width))
                            seen[window] = before = True
                    if before is not None and begin is None:
                        begin = first + i
                    if begin is not None and (before is None or i == n - 1):
                        out.append((key, begin, first + i + width - (before is None)))
                        begin = None
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], ["key", "begin", "end"])

    found = texts.select("key", "text").mapInArrow(light, "key binary, first int, n int, mini long")
    many = _kit.written(found.groupBy("mini").agg(F.count("*").alias("runs")).where("runs > 1"), "minimisers")
    salt, salts = _kit.salted(many, "mini", "runs")
    dealt = found.withColumn("_dealt", F.xxhash64("key", "first")).withColumn("_salt", salt).join(many.withColumn("_salt", F.explode(salts)), ["mini", "_salt"])
    # of a text's copies the one with the smallest id goes on, here and below
    travel = dealt.groupBy("key").agg(F.collect_set(F.struct("first", "n", "mini", (F.col("runs") >= HOT).alias("hot"))).alias("runs"))
    body = texts.join(copies.join(travel, "key").select("key", "low", "runs", F.explode("salts").alias("salt")), ["key", "salt"]).select("key", "text", "runs", F.col("id").eqNullSafe(F.col("low")).alias("first"))
    strings = body.mapInArrow(functools.partial(packed, held=HELD), "key binary, first int, n int, bucket long, string binary").repartition("bucket").sortWithinPartitions("bucket")
    spans = strings.mapInArrow(counted, "key binary, begin int, end int").groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    told = copies.join(spans, "key", "left").where("copies > 1 or spans is not null")
    return told.select("key", "copies", "spans", F.explode("salts").alias("salt"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, part: int = 6) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_text.

    Every word covered by a window of ``width`` words that also starts anywhere else, in the
    same text or another, is removed; kept_text is the other words joined by one space.
    Windows are judged on the input.  A null text has no words; texts of fewer than ``width``
    words lose nothing.  Rows that repeat a text are places of their own.  Ids may be null or
    repeat.  Texts may be of any length.  Other columns are ignored; an empty table gives an
    empty result.
    """
    source = keyed(docs, id_col, text_col)
    copies = _kit.written(source.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("low")), "copies")
    salt, salts = _kit.salted(copies, "key", "copies")
    source = source.withColumn("_dealt", F.xxhash64("id")).withColumn("salt", salt).drop("_dealt")
    told = repeated_spans(source, copies.withColumn("salts", salts), width, part)

    def cut(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for body, copies, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["copies"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                word = body.split()
                n.append(len(word))
                if (copies or 1) > 1 and len(word) >= width:
                    word = []
                elif spans:
                    keep = bytearray(b"\1") * len(word)
                    for x in spans:
                        keep[x["begin"] : x["end"]] = bytes(x["end"] - x["begin"])
                    word = list(itertools.compress(word, keep))
                gone.append(n[-1] - len(word))
                kept.append(b" ".join(word))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    out = source.join(told, ["key", "salt"], "left").select("id", "text", "copies", "spans").mapInArrow(cut, f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
