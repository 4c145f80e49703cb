"""Exact quantiles against Spark's own, over ties, nulls, hot and null keys and awkward sizes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles

POINTS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def plain(df, keys):
    return df.groupBy(*keys).agg(F.percentile("v", F.array(*(F.lit(p) for p in POINTS))).alias("_q"))


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_same_as_percentile(spark, keys):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randrange(2), r.choice([None, 0.0, 7.0, r.gauss(0, 1), r.randrange(50) / 3])) for _ in range(6000)]
    rows += [("one", 1, 3.5), ("none", 1, None), ("none", 1, None), ("two", 0, 1.0), ("two", 0, 2.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    want = {tuple(x[:-1]): x["_q"] for x in plain(df, keys).collect()}
    got = {tuple(x[:-1]): x["_q"] for x in quantiles(df, keys, "v", POINTS, parts=7).collect()}
    assert set(got) == set(want)
    for k, q in want.items():
        assert got[k] == ([None] * len(POINTS) if q is None else pytest.approx(q, rel=1e-12, abs=1e-12)), k


def test_integers_single_rows_and_nothing(spark):
    assert quantiles(spark.range(11), [], "id", (0.5, 0.25)).first()[0] == [5.0, 2.5]
    assert quantiles(spark.range(1), [], "id", (0.0, 0.3, 1.0)).first()[0] == [0.0, 0.0, 0.0]
    empty = spark.createDataFrame([], "k string, v double")
    assert quantiles(empty, ["k"], "v", (0.5,)).count() == 0
    assert quantiles(empty, [], "v", (0.5,)).first()[0] == [None]


def test_infinite_and_not_a_number(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("nan"),), (float("nan"),)], "v double")
    low, mid, top = quantiles(df, [], "v", (0.0, 0.5, 1.0)).first()[0]
    assert (low, mid) == (float("-inf"), 2.0)
    assert top != top


def test_one_value_only(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.lit(4).alias("v"))
    assert quantiles(df, ["k"], "v", (0.0, 0.5, 1.0)).first()["_q"] == [4.0, 4.0, 4.0]
