"""Every operator on texts longer than a slice of work, beside short ones, and the pipeline on an empty table."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
from helpers import SCHEMA, words
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import _kit, exact_dedup, minhash, mixing, packing, quality_classifier, quality_rules, substring, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long():
    """Two equal texts of over 5 MB, one that shares a passage with them, a word of 3 MB, and a short text."""
    rng = np.random.default_rng(4)
    vocab = [f"w{x}" for x in rng.integers(0, 10**6, 9000)]
    big = " ".join(vocab[i] for i in rng.integers(0, 9000, 800_000))
    assert len(big) > 2 * _kit.SLICE
    passage = " ".join(big.split()[500:560])
    return [(0, big, "en", "a", 0), (1, big, "en", "a", 0), (2, f"before {passage} after", "en", "b", 0), (3, "ab" * 1_500_000, "de", "b", 0), (4, "a short text", "de", "a", 0)]


@pytest.fixture(scope="module")
def docs(spark, long, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame(long, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_exact(docs, long):
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {d: ({0: 1}.get(d, d), 2 if d < 2 else 1, hashlib.sha256(t.encode()).hexdigest()) for d, t, *_ in long}


def test_tokens_and_packing(docs, long):
    library = Tokenizer.from_file(PATH)
    want = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t, *_ in long}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()} == want
    got = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in got} == {d: (n + 1, n + 1) for d, n in want.items()}


def test_near_and_passages(docs, long):
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(docs).collect()}
    w = words(long[0][1])
    assert [got[i][0] for i in range(5)] == [0, 0, 2, 3, 4]
    assert got[0][1] == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) and got[4][1] == 1
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring.without_repeats(docs).collect()}
    assert gone == {0: (len(w), len(w)), 1: (len(w), len(w)), 2: (62, 60), 3: (1, 0), 4: (3, 0)}


def test_rules_and_scores(spark, docs, long):
    got = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {d: (len(words(t)), sum(map(len, words(t)))) for d, t, *_ in long}
    labels = spark.createDataFrame([(0, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id: r.n_grams for r in quality_classifier.quality_classifier(docs, labels).collect()} == {d: 2 * len(words(t)) - 1 for d, t, *_ in long}
    assert {r.doc_id: r.tokens for r in mixing.mix(docs).collect()} == {d: (len(t) + 3) // 4 for d, t, *_ in long}


def test_pipeline_of_nothing_and_odd_rows(spark, tmp_path):
    """Empty tables, nulls in every column, and columns with names that stages use."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, found in (("none", []), ("nulls", [(None, None, None, None, None)] * 3 + [(1, "some text", None, None, None)] * 2)):
        docs = spark.createDataFrame(found, SCHEMA)
        docs = docs.withColumns({c: F.lit(1) for c in ("id", "key", "copies", "tokens", "carried", "part", "rate", "n", "text_sha256")})
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for stage, f in corpus_pipeline.STAGES:
            before = docs
            docs = f(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "packing":
                assert docs.columns == before.columns
                assert docs.count() == (0 if name == "none" else {"quality": 5, "exact dedup": 2, "near dedup": 2, "mixing": 1}[stage])
