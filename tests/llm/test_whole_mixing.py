"""Drawn shares of tokens against the targets, where rates pass the bound on copies."""

import duckdb
import pytest
from helpers import SCHEMA, by_repr, rows, table

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import mixing


def shares(drawn, name):
    """A value's share of the tokens drawn (rows of tokens, copies)."""
    found = {r[0]: float(r[1]) for r in drawn.groupBy(name).agg(F.sum(F.col("tokens") * F.col("copies"))).collect()}
    return {k: v / sum(found.values()) for k, v in found.items()}


def tempered(docs, name, power=0.5):
    found = {r[0]: float(r[1]) ** power for r in docs.groupBy(name).agg(F.sum("tokens")).collect()}
    return {k: v / sum(found.values()) for k, v in found.items()}


def uneven(spark, n=24_000):
    """One source, one language and one topic hold nine tenths of the rows each, independent of each other."""
    text = lambda i: ("a | b " if i // 100 % 10 == 0 else "x") + "y" * (40 + i % 7)
    docs = spark.createDataFrame([(i, text(i), ("en", "de")[i // 10 % 10 == 0], "ab"[i % 10 == 0], 0) for i in range(n)], SCHEMA)
    return docs.withColumns({"tokens": F.expr("(octet_length(text) + 3) div 4"), "topic": mixing.topic_of(F.col("text"))}).cache()


def test_pipeline_mixing_meets_all_targets(spark):
    """Within one document each, with most of what the rarest values allow."""
    docs = uneven(spark, 60_000)
    done = corpus_pipeline.mixed(spark, docs.drop("tokens", "topic"), "").cache()
    assert done.count() == done.distinct().count()
    drawn = done.withColumns({"tokens": F.expr("(octet_length(text) + 3) div 4"), "topic": mixing.topic_of(F.col("text")), "copies": F.lit(1)})
    room = 1.0
    for name in mixing.DIMENSIONS:
        got, want = shares(drawn, name), tempered(docs, name, corpus_pipeline.POWER)
        assert min(want.values()) < 0.3 and set(got) == set(want)
        plain = {r[0]: float(r[1]) for r in docs.groupBy(name).agg(F.sum("tokens")).collect()}
        room = min(room, *(plain[v] / sum(plain.values()) / want[v] for v in want))
        for value, share in want.items():
            assert got[value] == pytest.approx(share, abs=0.01), (name, value)
    assert done.count() > 0.9 * room * docs.count()


def test_bounded_raking_holds_marginals_and_limit(spark):
    docs = uneven(spark, 6_000)
    cells = docs.groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens")).cache()
    targets = {name: mixing.tempered(cells, name, 0.5) for name in mixing.DIMENSIONS}
    rates = mixing.raked(cells, targets, most=1).cache()
    assert 0.99 < rates.agg(F.max("rate")).first()[0] <= 1
    for name in mixing.DIMENSIONS:
        got = {r[0]: float(r[1]) for r in rates.groupBy(name).agg(F.sum(F.col("tokens") * F.col("rate"))).collect()}
        for value, share in tempered(docs, name).items():
            assert got[value] / sum(got.values()) == pytest.approx(share, abs=2.1 * mixing.TOLERANCE)


def test_null_ids_and_columns(spark):
    """Every row is answered; a null id draws as one id, a null value is a value."""
    found = rows()
    done = mixing.mix(table(spark, found)).collect()
    assert len(done) == len(found) and sum(r.doc_id is None for r in done) == 1
    assert all(r.copies == 0 for r in done if r.tokens == 0)
    with pytest.raises(ValueError):
        mixing.mix(table(spark, found), dims={"tokens": F.col("lang")})


def test_mixing_draws_rates_over_any_bound(spark):
    """A rare topic in a rare language of a rare source: rates multiply, far over 4."""
    docs = uneven(spark, 12_000)
    done = mixing.mix(docs.drop("tokens", "topic")).join(docs.select("doc_id", *mixing.DIMENSIONS), "doc_id").cache()
    assert done.agg(F.max("rate")).first()[0] > 10
    assert done.where((F.col("copies") < F.floor("rate")) | (F.col("copies") > F.floor("rate") + 1)).count() == 0
    total, drawn = done.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("copies"))).first()
    assert drawn == pytest.approx(total, rel=0.03)
    for name in mixing.DIMENSIONS:
        got = shares(done, name)
        for value, share in tempered(docs, name).items():
            assert got[value] == pytest.approx(share, abs=0.02), (name, value)


def test_mixing_matches_sql_without_bound(spark):
    found = [r for r in rows() if r[0] is not None]
    documents = __import__("pandas").DataFrame(found, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(mixing.mix_sql()).fetchall()
    assert max(r[3] for r in want) > 4
    assert by_repr(mixing.mix(table(spark, found)).select("doc_id", "tokens", F.round("rate", 6), "copies").collect()) == by_repr(want)


def jobs(spark, f):
    """f's result and the number of jobs it ran."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(f)}"
    spark.sparkContext.setJobGroup(group, "")
    out = f()
    return out, len(tracker.getJobIdsForGroup(group))


def marginals(rates, name):
    found = {r[0]: float(r[1]) for r in rates.groupBy(name).agg(F.sum(F.col("tokens") * F.col("rate"))).collect()}
    return {k: v / sum(found.values()) for k, v in found.items()}


def test_marginals_that_contradict_each_other(spark):
    """Each source has one language: no volume meets both; the fit ends, and the languages' shares hold."""
    kinds = [("news", "en", 900), ("wiki", "de", 300), ("web", "de", 500)]
    cells = spark.createDataFrame(kinds, "source string, lang string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"news": 0.7, "wiki": 0.1, "web": 0.2}), "lang": share({"en": 0.4, "de": 0.6})}
    for most in (None, 1, 0.25):
        rates, ran = jobs(spark, lambda: mixing.raked(cells, targets, most=most).cache())
        got = marginals(rates, "lang")
        assert got["en"] == pytest.approx(0.4, abs=0.005) and ran < 60
        assert marginals(rates, "source")["wiki"] == pytest.approx(0.2, abs=0.01)  # a third of what is left to de
        if most is not None:
            assert 0.98 * most < rates.agg(F.max("rate")).first()[0] <= most


def test_monolingual_sources_in_the_pipeline(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i % 7), ("en", "de", "de")[i % 3], ("news", "wiki", "web")[i % 3], 0) for i in range(1500)], SCHEMA)
    assert corpus_pipeline.mixed(spark, docs, "").count() > 1200


def test_targets_without_cells_and_values_without_targets(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "x", 100), ("b", "y", 50), ("c", "y", 0)], "source string, lang string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"a": 0.3, "b": 0.3, "c": 0.2, "nowhere": 0.2}), "lang": share({"x": 0.8, "y": 0.2})}
    for most in (None, 1):
        rates = mixing.raked(cells, targets, most=most).cache()
        assert marginals(rates, "source") == pytest.approx({"a": 0.5, "b": 0.5, "c": 0}, abs=0.005)
        assert marginals(rates, "lang") == pytest.approx({"x": 0.8, "y": 0.2}, abs=0.005)
    only = {"source": share({"b": 1.0}), "lang": share({"x": 0.5, "y": 0.5})}
    got = {(r.source, r.lang): r.rate for r in mixing.raked(cells, only, most=1).collect()}
    assert got["a", "x"] == got["c", "y"] == 0 and got["b", "y"] == pytest.approx(1, abs=0.02)
    assert {r.rate for r in mixing.raked(cells, {"source": share({"nowhere": 1.0})}, most=1).collect()} == {0.0}
    assert mixing.raked(cells.limit(0), only, most=1).collect() == []


def test_one_document_a_value(spark):
    """As many sources as documents: shares that are all rare are one."""
    docs = spark.createDataFrame([(i, "word " * (1 + i % 5), "en", f"s{i}", 0) for i in range(400)], SCHEMA)
    done = mixing.mix(docs, power=0.5, most_copies=1, least_share=0.01).collect()
    assert len(done) == 400 and sum(r.copies for r in done) > 390
    rates = mixing.mix(docs, power=0.5, most_copies=1).collect()
    assert len(rates) == 400 and max(r.rate for r in rates) <= 1


def test_rare_values_are_pooled(spark):
    cells = spark.createDataFrame([("a", 980), ("b", 9), ("c", 6), (POOLED, 5)], "source string, tokens long")
    got = {r.source: r["_source"] for r in mixing.pooled(cells, ["source"], 0.01).collect()}
    assert got == {"a": "a", "b": mixing.POOL, "c": mixing.POOL, POOLED: mixing.POOL}


#: A value that is named as the pool is.
POOLED = mixing.POOL
