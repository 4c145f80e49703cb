"""Running sums by ranges against plain windows: hot and null keys, ties, both directions, empty tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.operators.scan import running_sums


def rows(spark):
    r = random.Random(3)
    made = [(i, "hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.randrange(3000), r.choice([None, 1, 2, 5])) for i in range(4000)]
    return spark.createDataFrame(made, "id int, k string, at int, x int").repartition(6)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("current", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_same_as_a_window(spark, keys, current, descending):
    df = rows(spark)
    order = [F.col(c).desc() if descending else F.col(c) for c in ("at", "id")]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = df.withColumns({"s": F.coalesce(F.sum("x").over(w), F.lit(0)), "n": F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0))})
    got = running_sums(df, keys, order, {"s": F.col("x"), "n": F.lit(1)}, current, parts=7)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.select("id", "s", "n").collect())) == sorted(map(tuple, want.select("id", "s", "n").collect()))


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(20000).select("id", F.lit("hot").alias("k"))
    got = running_sums(df, ["k"], [F.col("id")], {"s": F.lit(1)}, parts=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan
    assert got.where("s = id").count() == 20000
    ranges = running_sums(df.withColumn("p", F.lit(0)), ["k"], [F.col("id")], {"s": F.lit(1)}, parts=8).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(ranges) > 1
    assert max(r["count"] for r in ranges) < 20000


def test_empty_and_replaced_columns(spark):
    empty = spark.createDataFrame([], "k string, at int, s int")
    assert running_sums(empty, ["k"], [F.col("at")], {"s": F.col("s")}).count() == 0
    one = spark.createDataFrame([("a", 1, 5), ("a", 2, 7)], "k string, at int, s int")
    assert [tuple(r) for r in running_sums(one, ["k"], [F.col("at")], {"s": F.col("s")}, current=True).orderBy("at").collect()] == [("a", 1, 5), ("a", 2, 12)]


def test_overdrafts(spark):
    df = spark.createDataFrame([("x", 1, 60.0), ("x", 2, 60.0), ("x", 3, None), ("x", 4, -50.0), ("y", 1, 100.0), (None, 1, 101.0)], "team string, at int, price double")
    got = {r["team"]: (r["overdraft"], r["overdrawn"]) for r in replay.overdrafts(df, ["team"], [F.col("at")], F.col("price"), 100.0).collect()}
    assert got == {"x": (20.0, 2), "y": (0.0, 0), None: (1.0, 1)}
