"""Helpers shared by the text operators: the shared scratch folder and array kernels over text.

The kernels work on the bytes of many texts at once, in slices of about ``SLICE`` bytes,
so a Python worker holds a few dozen MB whatever the size of its Arrow batch.  They run
inside ``mapInArrow`` tasks; Spark does all partitioning and shuffling.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 2 << 20
#: The white space that separates words, and the pattern of a word.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own; any other master is an error,
    since executors could not read what the driver's machine holds.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: lineage ends there.

    The table stays until ``dropped`` is told that nothing reads it any more, or until the
    folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote for these tables; no plan may read them any more."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            where, base = pyarrow.fs.FileSystem.from_uri(path)
            where.delete_dir(base)


#: A key is hot if it holds more than this share of the rows and at least so many of them; there
#: are fewer hot keys than one over the share, whatever the table.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 4096, 256, 64


def salted(weights: DataFrame, key: str, weight: str, total: int | None = None) -> tuple[Column, Column]:
    """What deals hot keys over many tasks: (salt, salts), columns for the side that has many rows
    of a key (a hash of its columns decides) and for the side that has one row for each.

    weights has one row for each key, with the number of the other side's rows in ``weight``;
    total is their sum, where the caller knows it.
    The first column is a function of the key and of a column ``_dealt`` (any long that varies
    within the key), the second is an array to be exploded.  Keys are told by their hash: one
    that shares a hot one's is dealt too, on both sides alike.
    """
    total = weights.agg(F.sum(weight)).first()[0] or 0 if total is None else total
    least = total * HOT_SHARE
    hot = [x[0] for x in weights.where((F.col(weight) > least) & (F.col(weight) >= HOT_ROWS)).select(F.xxhash64(key)).distinct().collect()]  # 4,096 at most
    if not hot:
        return F.lit(0), F.array(F.lit(0))
    is_hot = F.xxhash64(key).isin(hot)
    # never null, so that no join adds a condition of its own and joins can share a shuffle
    return F.coalesce(F.when(is_hot, F.pmod(F.col("_dealt"), F.lit(SALTS)).cast("int")), F.lit(0)), F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))


def text_of(column: str):
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


ODD = np.uint64(0xD6E8FEB86659FD93)
#: Starting values of the two hashes that name a span or a sequence together.
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x3C6EF372FE94F82B))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about ``most`` bytes."""
    data, offs = raw(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def words(data: np.ndarray, offs: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin among them (rows + 1).

    letters tells of each byte whether it belongs to a word; without it all but white space do.
    """
    inside = ~_SPACE[data] if letters is None else letters[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    at = offs[:-1][full]
    first[at] = inside[at]
    at = offs[1:][full] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: bool = False):
    """A 64-bit hash of each span of bytes, or a pair of two that are independent of each other.

    Spans are not empty.  A span is taken eight bytes at a time; each step multiplies and mixes,
    and the first is one to one, so spans of eight bytes at most have a hash of their own
    among those of their length.  Spans over ``LONG`` bytes go through XXH3.
    """
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return (none, none) if pairs else none
    size = ends - starts
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", room, strides=(1,))
    out = [mixed(size.astype(np.uint64) * ODD + seed) for seed in SEEDS[: 1 + pairs]]
    lane = lanes[starts] & ALL[np.minimum(size, 8)]
    out = [mixed(h ^ lane) for h in out]
    on = np.flatnonzero((size > 8) & (size <= LONG))
    step = 8
    while len(on):
        lane = lanes[starts[on] + step] & ALL[np.minimum(size[on] - step, 8)]
        for h, seed in zip(out, SEEDS, strict=False):
            h[on] = mixed((h[on] ^ lane) * ODD + seed)
        step += 8
        on = on[size[on] > step]
    for i in np.flatnonzero(size > LONG).tolist():
        span = data[starts[i] : ends[i]].tobytes()
        for h, seed in zip(out, SEEDS, strict=False):
            h[i] = xxhash.xxh3_64_intdigest(span, int(seed))
    return tuple(out) if pairs else out[0]


#: Masks of the first 0 to 8 bytes of a lane, and the longest span that is hashed lane by lane.
ALL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG = 256


def sequence_hashes(h: np.ndarray, n: int, seed: np.uint64 = SEEDS[0]) -> np.ndarray:
    """A hash of each n consecutive values (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, seed + np.uint64(n))
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * ODD
        out ^= out >> np.uint64(29)
    return mixed(out)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (a, b) comes first, and for every place the number of its pair."""
    _, first, back = np.unique(a, return_index=True, return_inverse=True)
    if (b[first][back] == b).all():
        return first, back
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of values as a list column."""
    at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
