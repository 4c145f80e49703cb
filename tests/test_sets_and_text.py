"""Similar sets by classes as by all pairs; text of odd doubles."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linkage
from tidemark.queries import ORACLE_SQL, QUERIES


def test_sets_by_class_as_by_pairs(spark):
    pick = random.Random(7)
    rows = [(d, k, pick.sample("abcdef", pick.randint(0, 4))) for d in "xyz" for k in range(30)] + [("alone", 1, ["a"]), (None, 1, ["a"]), ("apart", 1, ["a"]), ("apart", 2, ["b"])]
    u = spark.createDataFrame(rows, "day string, user int, s array<string>").withColumn("k", F.struct("user", "day"))
    b = u.select("day", F.col("user").alias("o"), F.col("s").alias("t"))
    pairs = u.join(b, "day").where("user <> o").select("k", "o", linkage.jaccard(F.col("s"), F.col("t")).alias("score"), F.size(F.array_intersect("s", "t")).alias("overlap"))
    few = linkage.set_candidates(u, "day", "user", "s")
    assert few.count() <= 4 * len(rows) < pairs.count()
    few = few.select(F.struct("user", "day").alias("k"), F.col("other").alias("o"), "score", "overlap")
    told = lambda c: sorted((tuple(r) for r in linkage.verdicts(u.select("k"), c, "k", "o").select("k.user", "k.day", "verdict", "score", "overlap", "runner_up", "linked_o").collect()), key=repr)
    assert told(few) == told(pairs)


@pytest.mark.parametrize("name", ["q05_money_parse"])
def test_odd_balances(spark, tmp_path, name):
    odd = [-0.0, 0.0, 0.01, -0.01, 0.001, 0.0005, 1e7, 12345678.9, 1e16, 1.5e17, 0.1 + 0.2, 4516.950000000001, 1e-5, float("nan"), float("inf"), None, 1234.565, 9999.99]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(odd)] + [(i + 101, x) for i, x in enumerate(odd)], "c_custkey long, c_acctbal double")
    table.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL[name]).fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
