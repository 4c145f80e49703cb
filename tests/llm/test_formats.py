import base64
import gzip
import hashlib

import pyarrow.fs
import pytest

from pyspark.sql import functions as F
from tidemark.llm import preference, warc

PAGES = [
    (1, "http://Www.Example.com:80/a?b=1#x", "<p>é</p>"),
    (2, "https://example.com/b c", "<p>é</p>"),
    (3, None, None),
    (4, "http://[bad", ""),
    (5, "http://example.com/a", "x" * 200_000),
    (6, "http://example.com/a", "y\r\n\r\nz"),
    (None, "http://example.com/n", "alone"),
    (None, "http://example.com/n", "<p>é</p>"),
    (7, "ftp://user:pw@example.com:21/a\n", "<p>é</p>"),
    *((10 + i, "http://example.com/hot", f"page {i % 40}") for i in range(90)),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "file", "at", "size", "page", "sha", "first")})


def test_round_trip(pages):
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        b, f = (h or "").encode(), first.get(h or "")
        response = f is None or i == f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else f))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_index_blocks_and_lookup(spark, pages, tmp_path):
    captures = warc.write_archives(pages, str(tmp_path)).cache()
    index = warc.write_index(captures, str(tmp_path), lines=7, files=3).cache()
    assert index.count() <= 3
    keys = spark.createDataFrame([("com,example)/hot",), ("com,example)/a",), ("none",), (None,), ("com,example)/hot",)], "key string")
    found = warc.lookup(keys, str(tmp_path), index).cache()
    want = captures.where(F.col("key").isin("com,example)/hot", "com,example)/a"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("key", "file", "at", "size").collect()))
    records = warc.fetch(found, str(tmp_path)).collect()
    assert {r.payload.decode() for r in records if r.payload and r.url.endswith("hot")} == {f"page {i}" for i in range(40)}
    reader = warc._In(str(tmp_path))
    for r in index.collect():
        blocks = warc.directory(reader, r.file)
        assert blocks[0][0] == r.first and [b[0] for b in blocks] == sorted(b[0] for b in blocks)


def test_archives_are_warc(pages, tmp_path):
    warc.write_archives(pages, str(tmp_path)).count()
    files = pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(str(tmp_path)))
    kinds = []
    for f in files:
        assert not f.base_name.startswith(".")
        rest = gzip.decompress(open(f.path, "rb").read())
        while rest:
            head, _, after = rest.partition(b"\r\n\r\n")
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            kinds.append(next(x for x in head.split(b"\r\n") if x.startswith(b"WARC-Type: "))[11:])
            assert after[size : size + 4] == b"\r\n\r\n"
            rest = after[size + 4 :]
    assert len(kinds) == len(PAGES) and set(kinds) == {b"response", b"revisit"}


def test_url_keys():
    assert warc.url_key("http://Www.Example.com:80/a?b=1#x") == "com,example,www)/a?b=1"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no%20url"


def test_empty_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TURNS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", "more"), (0, 4, "assistant", "sure"),
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "what"),
    (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
    (4, 0, "user", None), (4, 1, None, "x"), (5, 0, "user", ""), (5, None, "user", "first"),
    (6, 0, "user", "alone"), (None, 0, "user", "nobody's"),
    (8, 0, "user", "a"), (8, 0, "user", "a"), (9, 0, "user", "a"),
]


def brute(turns):
    convs = {}
    for c, *t in turns:
        if c is not None:
            convs.setdefault(c, []).append((-1 if t[0] is None else t[0], t[1] or "", t[2] or ""))
    out = []
    for c in sorted(convs):
        if c % 2 == 0 and c + 1 in convs:
            a, b = ([t[1:] for t in sorted(convs[x])] for x in (c, c + 1))
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            sides = []
            for side in (a[:k], a[k:], b[k:]):
                text, spans = "", []
                for role, said in side:
                    text += f"<|{role}|>\n"
                    start = len(text)
                    text += f"{said}<|end|>\n"
                    if role == "assistant":
                        spans.append((start, len(text)))
                sides.append((text, spans))
            out.append((c, c + 1, k, *(s[0] for s in sides), sides[1][1], sides[2][1]))
    return out


def test_preference(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("id", "t", "n", "c", "r")})
    done = preference.preference_pairs(turns, preference.neighbours(turns)).collect()
    got = [(*r[:6], [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask]) for r in done]
    assert sorted(got, key=repr) == sorted(brute(TURNS), key=repr)


def test_no_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.preference_pairs(turns, preference.neighbours(turns)).count() == 0


def test_marks_in_texts(spark):
    """A text that holds marks is one turn all the same."""
    turns = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "b<|end|>\n<|user|>\nc"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (r,) = preference.preference_pairs(turns, preference.neighbours(turns)).collect()
    assert r.chosen.count("<|") == 2 and r.n_common == 1
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["b< |end|>\n< |user|>\nc<|end|>\n"]


def test_pages_that_repeat_and_long_ones(spark):
    """Rows that repeat an id are records of their own; a payload of 5 MB comes back whole; all bodies are hot."""
    long = "0123456789" * 500_000
    rows = [(1, "http://a.example/x", long), (2, "http://a.example/x", long), (3, "http://a.example/y", "z"), (3, "http://a.example/y", "z")]
    got = sorted(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(1, 5_000_000, "response", None), (2, 5_000_000, "revisit", 1), (3, 1, "response", None), (3, 1, "response", None)]


def test_attempts_leave_no_mark(spark, tmp_path, pages):
    """Captures name their own attempt's files, whatever others left in the folder."""
    first = warc.write_archives(pages, str(tmp_path)).collect()
    second = warc.write_archives(pages, str(tmp_path)).collect()
    assert not {r.file for r in first} & {r.file for r in second}
    records = warc.fetch(spark.createDataFrame(first), str(tmp_path)).count()
    assert records == len(PAGES)
