"""Linking a feed reads its balls once for each output, and no group holds all that is unlinked."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import linkage
from tidemark.plans import shots

DAY = datetime.date(2020, 4, 1)


@pytest.fixture
def read(spark):
    rows = [(m, DAY, b % 4, f"N{b % 4}", 4 + b % 2, f"N{4 + b % 2}") for m in range(5) for b in range(8)]
    times = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: times.add(1) or x, "int").asNondeterministic()
    df = spark.createDataFrame(rows, "p_match int, date date, p_bat int, bat string, p_bowl int, bowl string")
    return df.withColumn("p_match", seen("p_match")), times, len(rows)


def test_players_read_the_balls_once(spark, read):
    balls, times, n = read
    people = spark.createDataFrame([(f"p{i}", i if i % 2 else None, f"N{i}") for i in range(6)], "person_id string, key int, variants string")
    balls = balls.where("p_match >= 0")
    assert shots.player_crosswalk(balls, people).where("person_id is not null").count() == 6
    assert times.value <= 2 * n  # a batter's and a bowler's row of each


def test_matches_read_the_balls_once(spark, read):
    balls, times, n = read
    players = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "player_id int, person_id string")
    theirs = spark.createDataFrame([("m", DAY, f"p{i}", "p4") for i in range(4)] + [("far", DAY + datetime.timedelta(9), "p1", "p4")], "match_id string, match_date date, striker_id string, bowler_id string")
    got = {r.p_match: r.status for r in shots.match_crosswalk(balls, players, theirs).collect()}
    assert got == {0: "ok", **{m: "duplicate_claim" for m in range(1, 5)}}
    assert times.value <= n


def test_what_claims_nothing_is_no_group(spark):
    df = spark.createDataFrame([(i, "x" if i < 3 else None, "ok" if i < 3 else "weak") for i in range(60)], "k int, claimed string, verdict string")
    done = linkage.claim_once(df, "claimed", [F.col("k")])
    assert [r.k for r in done.where("verdict = 'ok'").collect()] == [0] and done.where("verdict = 'weak'").count() == 57
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = max(r["count"] for r in done.where("verdict = 'weak'").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 57


def test_balls_of_unlinked_matches_are_not_ordered(spark):
    """Deliveries are cut to linked matches before they are numbered."""
    source = spark.createDataFrame([(m, DAY, 1, b, 1, 2, None, None, None, None) for m in (1, 2) for b in range(3)], "p_match int, date date, innings int, ball_id int, p_bat int, p_bowl int, control string, shot string, elevation string, binary double")
    theirs = spark.createDataFrame([(f"m{m}", 1, b, "p1", "p2", False) for m in range(1, 40) for b in range(3)], "match_id string, innings int, ball_seq int, striker_id string, bowler_id string, super_over boolean")
    matches = spark.createDataFrame([(1, "m1"), (2, None)], "p_match int, match_id string")
    done = shots.ball_attributes(source, spark.createDataFrame([(1, "p1")], "player_id int, person_id string"), matches, theirs, [])
    assert sorted((r.match_id, r.ball_seq) for r in done.collect()) == [("m1", 0), ("m1", 1), ("m1", 2)]
    assert "LeftSemi" in done._jdf.queryExecution().optimizedPlan().toString()
