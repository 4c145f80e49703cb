"""WARC archives with a two-level capture index.

Records are gzip members in archive files that tasks write to a shared folder.  A file's name
holds the task attempt that wrote it, and captures name the files of the attempt that was
committed; what a lost or repeated attempt leaves is read by nobody.  The index holds
captures sorted by URL key with the host reversed, in compressed blocks; every index file
ends in a sparse directory of its blocks.  A lookup binary-searches the files' first keys,
then a directory, and reads ranges: blocks, then records.  A key with very many captures
spans blocks, and blocks are dealt among tasks.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _kit

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Files of the index at most; their first keys are all that a lookup task is sent beforehand.
MOST_FILES = 4096
#: Bytes of an archive that one task reads back, about.
SEGMENT = 8 << 20


def url_key(url: str | None) -> str:
    """The URL with its host reversed, lower-cased and first: com,example,www)/path?query.

    Schemes, default ports, user names and fragments are left out, blanks are escaped.  What
    isn't a URL with a host is its own key; null is the empty key.
    """
    url = (url or "").strip()
    try:
        found = urlsplit(url)
        host, port = found.hostname, found.port
    except ValueError:
        host, port = None, None
    if host:
        port = "" if port in (None, {"http": 80, "https": 443}.get(found.scheme)) else f":{port}"
        url = ",".join(reversed(host.split("."))) + port + ")" + (found.path or "/") + (f"?{found.query}" if found.query else "")
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(row: dict, date: str) -> bytes:
    """A WARC record as bytes; a revisit has the response's HTTP header only."""
    body = row["html"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    kind = "response" if row["response"] else "revisit"
    block = http + body if row["response"] else http
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{row['record']}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c if c >= " " else f"%{ord(c):02X}" for c in row["url"] or "")),
        ("WARC-Payload-Digest", f"sha1:{base32(hashlib.sha1(body).digest())}"),
        *([] if row["response"] else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{row['first']}>")]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], int, bytes]:
    """A record's header fields, its payload's full length, and the payload it holds."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("this is no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    http, _, body = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, body


class _Out:
    """A file in the shared folder that appears whole when closed."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, base = pyarrow.fs.FileSystem.from_uri(folder)
        self.path, self.at = f"{base}/{name}", 0
        self.draft = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.files.open_output_stream(self.draft)

    def write(self, data: bytes) -> int:
        """The offset at which the data were put."""
        at, self.at = self.at, self.at + len(data)
        self.stream.write(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.draft, self.path)


class _In:
    """Range reads from the files of a folder; one file is open at a time."""

    def __init__(self, folder: str) -> None:
        self.files, self.base = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def open(self, name: str):
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.files.open_input_file(f"{self.base}/{name}")
        return self.file

    def read(self, name: str, at: int, size: int) -> bytes:
        file = self.open(name)
        file.seek(at)
        return file.read(size)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z", most_bytes: int = 1 << 30) -> DataFrame:
    """Writes a record per row; returns (key, page, file, at, size) of each.

    Of rows with equal payloads (equal in SHA-1, SHA-256 and length) that with the smallest id
    is a response, the others are revisits of it.  Rows with a null id are revisits of the group's smallest id, or all
    responses if it has none; rows that repeat the smallest id are responses too.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), _kit.text_of(body_col).alias("html"))
    digest = F.concat(F.unhex(F.sha1(F.col("html").cast("binary"))), F.unhex(F.sha2(F.col("html"), 256)), F.octet_length("html").cast("string").cast("binary"))
    base = base.withColumn("same", digest)
    first = _kit.written(base.groupBy("same").agg(F.min("page").alias("first"), F.count("*").alias("pages")), "payloads")

    def put(batches):
        task, n, out, rows = TaskContext.get(), 0, None, []
        for batch in batches:
            for row in zip(*(batch[x].to_pylist() for x in ("page", "url", "html", "first", "response")), strict=True):
                row = dict(zip(("page", "url", "html", "first", "response"), row, strict=True))
                if out is None or out.at >= most_bytes:
                    if out:
                        out.close()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:03d}.warc.gz"
                    out, n = _Out(folder, name), n + 1
                row["html"] = row["html"].encode()
                row["record"] = f"urn:page:{row['page']}" if row["page"] is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{out.at}')}"
                data = gzip.compress(_record(row, date), 6, mtime=0)
                rows.append((url_key(row["url"]), row["page"], name, out.write(data), len(data)))
            if len(rows) > 5000:
                yield _captures(rows, pages_type)
                rows = []
        if out:
            out.close()
        yield _captures(rows, pages_type)

    from pyspark.sql.pandas.types import to_arrow_type

    pages_type = to_arrow_type(pages.schema[id_col].dataType)
    salt, salts = _kit.salted(first, "same", "pages")  # a body that very many pages have is dealt over tasks
    base = base.withColumn("_dealt", F.xxhash64("page", "url")).withColumn("_salt", salt)
    rows = base.join(first.withColumn("_salt", F.explode(salts)), ["same", "_salt"]).select("page", "url", "html", "first", (F.col("first").isNull() | F.coalesce(F.col("page") == F.col("first"), F.lit(False))).alias("response"))
    return rows.mapInArrow(put, f"key string, page {kind}, file string, at long, size long")


def _captures(rows: list[tuple], page: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), page, pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["key", "page", "file", "at", "size"])


def write_index(captures: DataFrame, folder: str, lines: int = 3000, files: int | None = None) -> DataFrame:
    """Writes the index of captures (key, page, file, at, size); returns (first, file) of its files.

    ``lines`` captures make a block.  An index file is its blocks, its directory (compressed
    JSON of each block's first key, offset and length) and the directory's length.
    """
    files = min(files or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_FILES)

    def put(batches):
        task = TaskContext.get()
        rows = (f"{k} {json.dumps([f, a, s])}" for b in batches for k, f, a, s in zip(*(b[x].to_pylist() for x in ("key", "file", "at", "size")), strict=True))
        out, blocks, name = None, [], f"index-{task.partitionId():05d}-{task.taskAttemptId()}.gz"
        for block in iter(lambda: list(itertools.islice(rows, lines)), []):
            out = out or _Out(folder, name)
            data = gzip.compress("\n".join(block).encode(), 6, mtime=0)
            blocks.append((block[0].partition(" ")[0], out.write(data), len(data)))
        if out:
            tail = gzip.compress(json.dumps(blocks).encode(), 6, mtime=0)
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks[:1]], pa.string()), pa.array([name] * bool(blocks), pa.string())], ["first", "file"])

    dealt = captures.repartitionByRange(files, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    return dealt.mapInArrow(put, "first string, file string")


def directory(reader: _In, name: str) -> list[list]:
    """The sparse directory at the end of an index file."""
    file = reader.open(name)
    size = file.size()
    (tail,) = struct.unpack("<Q", reader.read(name, size - 8, 8))
    return json.loads(gzip.decompress(reader.read(name, size - 8 - tail, tail)))


def _spans(keys: list[str], key: str) -> range:
    """Which of the sorted runs with these first keys may hold the key."""
    return range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key))


def lookup(keys: DataFrame, folder: str, index: DataFrame) -> DataFrame:
    """(key, file, at, size) of all captures of the keys (column key); index is what write_index returned."""
    tops = sorted((x["first"], x["file"]) for x in index.limit(MOST_FILES + 1).collect())
    if len(tops) > MOST_FILES:
        raise ValueError(f"an index has {MOST_FILES} files at most")

    def blocks(batches):
        reader, firsts, known = _In(folder), [x[0] for x in tops], {}  # a few directories at a time
        for batch in batches:
            out = []
            for key in batch["key"].to_pylist():
                for i in _spans(firsts, key):
                    name = tops[i][1]
                    if name not in known:
                        if len(known) > 16:
                            known.clear()
                        known[name] = directory(reader, name)
                    found = known[name]
                    out += [(name, found[j][1], found[j][2], key) for j in _spans([x[0] for x in found], key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "at", "size", "key"])

    def lines(batches):
        reader = _In(folder)
        rows = ((f, a, s, k) for b in batches for f, a, s, k in zip(*(b[x].to_pylist() for x in ("file", "at", "size", "key")), strict=True))
        for (name, at, size), group in itertools.groupby(rows, lambda x: x[:3]):
            wanted = {x[3] for x in group}
            found = []
            for line in gzip.decompress(reader.read(name, at, size)).decode().split("\n"):
                key, _, rest = line.partition(" ")
                if key in wanted:
                    found.append((key, *json.loads(rest)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "at", "size"])

    near = keys.select("key").where("key is not null").distinct().sortWithinPartitions("key").mapInArrow(blocks, "file string, at long, size long, key string")
    return near.repartition("file", "at").sortWithinPartitions("file", "at", "size").mapInArrow(lines, "key string, file string, at long, size long")


def fetch(captures: DataFrame, folder: str) -> DataFrame:
    """The records at (file, at, size): record_id, record_type, url, payload_bytes, payload_digest, refers_to, payload.

    payload_bytes and payload_digest are those of the full payload; payload is null for a
    revisit.  A response whose payload doesn't have its digest raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]):
        reader = _In(folder)
        names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for start in range(0, len(batch), 256):
                out = []
                for name, at, size in zip(*(batch.slice(start, 256)[x].to_pylist() for x in ("file", "at", "size")), strict=True):
                    fields, full, body = parse(gzip.decompress(reader.read(name, at, size)))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    response = fields["warc-type"] == "response"
                    if response and (base32(hashlib.sha1(body).digest()) != digest or len(body) != full):
                        raise ValueError(f"{name}, {at}: the payload isn't what was written")
                    out.append((fields["warc-record-id"].strip("<>"), fields["warc-type"], fields["warc-target-uri"], full, digest, fields.get("warc-refers-to", "").strip("<>") or None, body if response else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)

    captures = _kit.written(captures, "found")
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), (captures.agg(F.sum("size")).first()[0] or 0) // SEGMENT)
    dealt = captures.withColumn("segment", F.expr(f"at div {SEGMENT}")).repartition(int(parts), "file", "segment").sortWithinPartitions("file", "at")
    return dealt.drop("segment").mapInArrow(read, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct URL keys of a table."""

    def made(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch["url"].to_pylist()], pa.string())], ["key"])

    return pages.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(made, "key string").distinct()


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[str, DataFrame]:
    """Writes archives and index of a table into a new shared folder; returns the folder and the index's files."""
    folder = f"{_kit.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    captures = _kit.written(write_archives(pages, folder, id_col, url_col, body_col), "captures")
    return folder, _kit.written(write_index(captures, folder), "index")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Archives every row, then looks up every URL and reads its records back: one row per input row
    with id_col, payload_bytes, payload_digest, record_type and refers_to (the response's id).

    A null body is the empty payload; equal payloads are one response and revisits, empty ones
    too.  A null URL has the empty key.  A record of a null id has a null id.  Rows that repeat
    an id are records of their own.  Payloads may be of any length.  Other columns are ignored;
    an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType
    folder, index = archive(pages.sparkSession, pages, id_col, url_col, body_col)
    found = fetch(lookup(keys_of(pages, url_col), folder, index), folder)
    page = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring(c, 10, 1 << 20)).cast(kind)
    return found.select(page("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
