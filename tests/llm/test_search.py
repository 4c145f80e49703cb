"""Ranked search against brute force, and against the query's SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas
import pytest
from helpers import SCHEMA, by_repr, lowered, rows, table

from tidemark.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASKED = "item_id long, text string"


def brute(found, asked, k=10):
    counts = [(d, Counter(TERM.findall(lowered(t)))) for d, t, *_ in found]
    counts = [x for x in counts if x[1]]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in asked:
        scores = []
        for doc, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lowered(text))) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def asked_of(found):
    said = [r[1] for r in found if r[1]]
    texts = [said[0], said[5][:200], said[-3], "und X one", "nothing_of_it qqqq", "", None, "A " * 50, said[2] * 2, "naïve 漢字", "a", "B"]
    return [(i, t) for i, t in enumerate(texts)] + [(0, said[1]), (None, said[9])]


@pytest.mark.parametrize(("shard", "run"), [(32_768, 4_096), (13, 5)])
def test_ranks(spark, monkeypatch, shard, run):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "RUN", run)
    found = rows()
    asked = asked_of(found)
    got = search.ranked(table(spark, found).repartition(3), spark.createDataFrame(asked, ASKED)).collect()
    assert by_repr(got) == by_repr(brute(found, asked))


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 20)
    found = rows(seed=8, n=60)
    asked = asked_of(found)
    assert by_repr(search.ranked(table(spark, found), spark.createDataFrame(asked, ASKED), k=3).collect()) == by_repr(brute(found, asked, 3))


def test_as_its_sql(spark):
    found = [r for r in rows(seed=4) if r[0] is not None]
    asked = [x for x in asked_of(found) if x[0] is not None]
    documents = pandas.DataFrame(found, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    benchmark = pandas.DataFrame(asked, columns=["item_id", "text"])  # noqa: F841
    want = duckdb.sql(queries.ORACLE_SQL["op12_lexical_search"]).fetchall()
    assert by_repr(search.ranked(spark.createDataFrame(found, SCHEMA), spark.createDataFrame(asked, ASKED)).collect()) == by_repr(want)


def test_empty_tables_and_ties(spark):
    none, asked = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "some text")], ASKED)
    assert search.ranked(none, asked).collect() == []
    docs = spark.createDataFrame([(i, "some text", "en", "a", 9) for i in range(40, 0, -1)] + [(99, "other words here", "en", "a", 9)], SCHEMA)
    assert search.ranked(docs, asked.limit(0)).collect() == []
    assert [(r["rank"], r.doc_id) for r in search.ranked(docs, asked).orderBy("rank").collect()] == [(i, i) for i in range(1, 11)]


def test_wand_skips_and_loses_nothing():
    rng = np.random.default_rng(1)
    n = rng.integers(20, 400, 20_000)
    weight = np.sort(rng.integers(100, 9_000, 60))
    chance = np.exp(-weight / 1500)  # heavy terms are rare
    held = rng.random((len(n), len(weight))) < chance
    owner, term = np.nonzero(held)
    tf = rng.integers(1, 4, len(owner))
    shard = search.Shard(n, owner, term.astype(np.int32), tf, weight, len(n), int(n.sum()))
    asked = np.sort(rng.choice(len(weight), 25, replace=False))
    scored = []
    whole = type(shard).scored
    shard.scored = lambda a, d: (scored.append(len(d)), whole(shard, a, d))[1]
    got = sorted(shard.top(asked, 10), key=lambda x: (-x[0], x[1]))
    every = whole(shard, asked.tolist(), np.arange(len(n)))
    assert got == sorted(((int(s), d) for d, s in enumerate(every)), key=lambda x: (-x[0], x[1]))[:10]
    assert sum(scored) < len(n) / 3


def test_lengths_beyond_64_bits():
    n = np.array([1, 2**40], np.int64)
    assert search.lengths(n, 2**30, 2**45).tolist() == [10 + 90 * int(x) * 2**30 // 2**45 for x in n]
