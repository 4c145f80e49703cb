"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so, hence equal texts are
cut alike.  Every chunk's content travels once, to be compared with the chunks of the same
digest; where contents differ under one digest they get different identifiers.  A text is
then its recipe, the ordered list of its chunks' identifiers, and recipes alone are grouped
and joined: no document's text is moved again however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _kit

_GEAR = (_kit.mixed(np.arange(256, dtype=np.uint64) + np.uint64(77)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cut_points(data: np.ndarray, offs: np.ndarray, bits: int = 12, least: int = 512, most: int = 65_536) -> list[list[int]]:
    """For each row the ends of its chunks, from the row's start; 2**bits bytes apart on average."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0)
    row = np.searchsorted(offs, marks, "right") - 1
    whole = marks - offs[row] >= 31  # the hash has seen bytes of this row only
    marks, row = marks[whole], row[whole]
    begins = np.searchsorted(row, np.arange(len(offs)))
    out = []
    for i, size in enumerate((offs[1:] - offs[:-1]).tolist()):
        ends, last = [], 0
        for mark in (*(marks[begins[i] : begins[i + 1]] - offs[i] + 1).tolist(), size):
            if mark - last < least and mark != size:
                continue
            while mark - last > most:
                last += most
                ends.append(last)
            if mark > last:
                ends.append(last := mark)
        out.append(ends)
    return out


def _chunked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, int, bytes, list[int]]]:
    for batch in batches:
        for row, _, data, offs in _kit.slices(batch["text"]):
            for i, ends in enumerate(cut_points(data, offs, bits)):
                yield batch, row + i, data[offs[i] : offs[i + 1]].tobytes(), ends


def _pieces(text: bytes, ends: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 12, digest_bytes: int = 16) -> DataFrame:
    """(id, text_sha256, recipe) per row; recipe is the ordered list of verified chunk identifiers.

    The texts are read twice: for their chunks, whose contents are compared under their digests,
    and for their recipes.  Where contents differ under a digest, a third reading numbers them.
    """
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))
    key = source.schema["id"].dataType.simpleString()

    def digest(chunk: bytes) -> bytes:
        return xxhash.xxh3_128_digest(chunk)[:digest_bytes]

    def chunks(batches):
        held: list[bytes] = []
        size = 0
        for _, _, text, ends in _chunked(batches, bits):
            held += _pieces(text, ends)
            size += len(text)
            if size > 4 * _kit.SLICE:
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in held], pa.binary()), pa.array(held, pa.binary())], ["digest", "chunk"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in held], pa.binary()), pa.array(held, pa.binary())], ["digest", "chunk"])

    def lists(batches):
        for batch in batches:
            sha, out = [], []
            for _, _, text, ends in _chunked(iter([batch]), bits):
                sha.append(hashlib.sha256(text).hexdigest())
                out.append(b"".join(digest(x) for x in _pieces(text, ends)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sha, pa.string()), pa.array(out, pa.binary())], ["id", "text_sha256", "recipe"])

    def rows(batches):
        n, part = 0, TaskContext.get().partitionId()
        for batch, row, text, ends in _chunked(batches, bits):
            pieces = _pieces(text, ends) or [b""]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{n}"] * len(pieces)), pa.concat_arrays([batch["id"].slice(row, 1)] * len(pieces)), pa.array([hashlib.sha256(text).hexdigest()] * len(pieces)), pa.array(range(len(pieces)), pa.int64()), pa.array([digest(x) for x in pieces], pa.binary()), pa.array(pieces, pa.binary())],
                ["row", "id", "text_sha256", "pos", "digest", "chunk"],
            )
            n += 1

    distinct = source.select("text").mapInArrow(chunks, "digest binary, chunk binary").groupBy("digest", "chunk").agg(F.count("*").alias("n"))
    shared = distinct.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")
    shared = _kit.written(shared, "digests")  # digests of more than one content; none, as a rule
    if shared.isEmpty():
        _kit.dropped(shared)
        return source.mapInArrow(lists, f"id {key}, text_sha256 string, recipe binary")
    ranked = distinct.join(shared, "digest", "left_semi").select("digest", "chunk", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")).alias("ordinal"))
    named = source.mapInArrow(rows, f"row string, id {key}, text_sha256 string, pos long, digest binary, chunk binary").join(ranked, ["digest", "chunk"], "left")
    part = F.struct("pos", F.concat(F.hex("digest"), F.lit("."), F.coalesce("ordinal", F.lit(0)).cast("string")).alias("name"))
    return named.groupBy("row", "id", "text_sha256").agg(F.array_join(F.sort_array(F.collect_list(part))["name"], ",").cast("binary").alias("recipe")).drop("row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 12, digest_bytes: int = 16) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts the largest id stays.  A null text is the empty text; empty
    texts are equal to each other.  Null ids are smaller than all others: a group without any
    id has a null keep_id.  Rows that repeat an id with the same text count in group_size and
    share their flag.  Texts may be of any length.  Other columns are ignored.  An empty table
    gives an empty result.
    """
    made = _kit.written(recipes(docs, id_col, text_col, bits, digest_bytes), "recipes")
    groups = made.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = _kit.written(groups.where("group_size > 1"), "groups")  # a text of its own is its own group
    salt, salts = _kit.salted(groups, "recipe", "group_size")
    rows = made.withColumn("_dealt", F.xxhash64("id")).withColumn("_salt", F.coalesce(salt, F.lit(0))).join(groups.withColumn("_salt", F.explode(salts)), ["recipe", "_salt"], "left")
    keep, size = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")
