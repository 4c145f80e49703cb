"""The replay of an auction told by hand, and the blocks of the training table."""

import pytest

from pyspark.sql import functions as F
from tidemark.plans import auction, dataset

ROSTER = "auction int, position int, player int, role string, overseas boolean, base double, price double, status string, buyer string"
LOTS = [
    (1, 0, 9, "BOWLER", True, 20.0, 100.0, "RETAINED", "A"),
    (1, 1, 1, "BATTER", False, 20.0, 60.0, "SOLD", "A"),
    (1, 2, 2, "BOWLER", True, 20.0, 90.0, "RTM", "C"),
    (1, 3, 3, "BATTER", True, 30.0, None, "UNSOLD", None),
    (1, 4, 4, "COACH", None, 50.0, 40.0, "Sold", "nobody"),
]
BIDS = [(1, 1, "A", 1, 20.0), (1, 1, "B", 2, 50.0), (1, 1, "A", 3, 60.0), (1, 2, "A", 1, 20.0), (1, 2, "B", 2, 90.0), (1, 4, "B", 1, 50.0), (1, 4, "A", 2, 45.0)]


@pytest.fixture
def done(spark):
    bids = spark.createDataFrame(BIDS, "auction int, player int, team string, number int, amount double")
    teams = spark.createDataFrame([("A",), ("B",), ("C",), ("C",)], "team string")
    return auction.replay(spark.createDataFrame(LOTS, ROSTER), bids, teams, auction.Rules(200.0, slots=2, overseas=1))


def test_states_before_every_lot(done):
    team = {(r.lot, r.team): (r.purse_left, r.slots_left, r.players_bought, r.overseas_bought, r.batters_bought, r.bowlers_bought) for r in done.team_state().collect()}
    assert len(team) == 12
    assert team[1, "A"] == (100.0, 1, 1, 1, 0, 1) and team[2, "A"] == (40.0, 0, 2, 1, 1, 1) == team[4, "A"]
    assert team[2, "C"] == (200.0, 2, 0, 0, 0, 0) and team[3, "C"] == (110.0, 1, 1, 1, 0, 1)
    pool = {r.lot: (r.players_completed, r.players_remaining, r.remaining_batters, r.remaining_bowlers, r.remaining_overseas) for r in done.auction_state().collect()}
    assert pool == {1: (0, 4, 2, 1, 2), 2: (1, 3, 1, 1, 2), 3: (2, 2, 1, 0, 1), 4: (3, 1, 0, 0, 0)}


def test_intervals(done):
    got = {(r.lot, r.team): (r.observation_type, r.lower, r.upper, r.last_bid, r.previous_bid) for r in done.bid_summary().collect()}
    assert got[1, "A"] == ("right", 60.0, 120.0, 60.0, 20.0)
    assert got[1, "B"] == ("interval", 50.0, 60.0, 50.0, 20.0)
    assert got[1, "C"] == ("left", 0.01, 20.0, None, None)
    assert got[2, "C"] == ("right", 90.0, 180.0, None, None)  # matched the highest bid without one of its own
    assert got[2, "B"] == ("right", 90.0, 180.0, 90.0, 20.0)
    assert got[3, "A"] == ("left", 0.01, 30.0, None, None)


def test_recoveries_and_final_states(spark, done):
    report = {r.check: r.value for r in done.quality().collect()}
    assert report == {"buyer_absent_from_ladder": 1, "unresolvable_buyer": 1, "next_bid_backfilled": 2, "matched_at_top": 2, "dropped_bad_interval": 0, "sale_price_missing": 0, "sale_price_below_base": 0, "ladders_that_fall": 1}
    assert {(r.team, r.purse_left, r.slots_left, r.overseas_bought) for r in done.final_state().collect()} == {("A", 40.0, 0, 1), ("B", 200.0, 2, 0), ("C", 110.0, 1, 1)}
    assert done.violations().count() == 0
    stated = spark.createDataFrame([(1, "A", 40.0), (1, "C", 120.0)], "auction int, team string, purse_left double")
    assert [(r.team, r.check, r.value) for r in done.violations(stated).collect()] == [("C", "purse differs from declared", -10.0)]


def test_outputs_scan_one_table(done):
    for out in (done.training(), done.auction_state(), done.team_state(), done.bid_summary()):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and plan.count("FileScan") == 1


def test_unknown_status(spark):
    teams, bids = spark.createDataFrame([("A",)], "team string"), spark.createDataFrame(BIDS, "auction int, player int, team string, number int, amount double")
    odd = spark.createDataFrame([(1, 1, 1, "BATTER", False, 1.0, 1.0, "LOST", "A")], ROSTER)
    with pytest.raises(Exception, match="unknown status"):
        auction.replay(odd, bids, teams, auction.Rules(1.0))
    none = auction.replay(odd.limit(0), bids, teams, auction.Rules(1.0))
    assert none.training().count() == none.quality().count() == none.violations().count() == 0


def test_role_table(spark):
    roles = spark.createDataFrame([(1, True, 2.0, "left", "k1", 7, None), (2, None, 3.0, "right", "k2", 8, None), (3, None, None, None, "k3", 9, None)], "playerId int, opener boolean, skill double, hand string, code string, n_auctions int, tag int")
    rows = spark.createDataFrame([(i, i % 5) for i in range(10)], "row int, playerId int")
    out, names, told = dataset.role_table(rows, roles, most=2)
    assert {r.column: r.verdict for r in told.collect()} == {"opener": "constant", "skill": "number", "hand": "category", "code": "too many values", "n_auctions": "leaky", "tag": "constant"}
    assert names == ["opener", "skill", "hand_left", "hand_right", "tag", "role_is_missing"]
    got = {r.row: tuple(r[n] for n in names) for r in out.collect()}
    assert len(got) == 10 and got[1] == (1.0, 2.0, 1.0, 0.0, None, 0.0) and got[3] == (None, None, 0.0, 0.0, None, 0.0) and got[4] == got[9] == (None,) * 5 + (1.0,)
    again, same, _ = dataset.role_table(out, roles, most=2)
    assert same == names and sorted(again.select(out.columns).collect()) == sorted(out.collect()) or again.count() == 10
    with pytest.raises(Exception, match="key is repeated"):
        dataset.role_table(rows, roles.union(roles.limit(1)), most=2)[0].collect()
    plain, names, _ = dataset.role_table(spark.createDataFrame([("BOWLER",), (None,)], "role string"), None)
    assert names == ["role_BOWLER"] and sorted(r[1] for r in plain.collect()) == [0.0, 1.0]


def test_equal_columns(spark):
    df = spark.createDataFrame([(1, 1, 2, None), (2, 2, 2, None), (None, None, 3, None)], "a int, b int, c int, d int")
    facts = dataset.column_facts(df, df.columns)
    assert facts["b"]["equals"] == "a" and facts["a"]["equals"] is facts["c"]["equals"] is facts["d"]["equals"] is None
    assert facts["a"] == {"distinct": 2, "nulls": 1, "equals": None} and facts["d"]["nulls"] == 3
    assert dataset.column_facts(df.limit(0), ["a", "b"])["b"]["equals"] is None


def test_promotion(spark):
    df = spark.createDataFrame([(1.5, " capped", True), (None, "UNCAPPED", None), (2.0, "who knows", False)], "basePrice double, cappedStatus string, isPlayerOverseas boolean")
    out, block = dataset.promoted(df, (*dataset.CONTEXT, "absent"), ["first"])
    assert block[0] == "first" and len(block) == 7 and out.select(block[1:]).collect()[1] == (None, 1.0, 0.0, 0.0, None, 1.0)
    again, same = dataset.promoted(out, block=block)
    assert same == block and again.columns == out.columns
    told = {r.column: (r.distinct, r.missing, r.constant, r.unrecognised) for r in dataset.promotion_report(out).collect()}
    assert told == {"basePrice": (2, 1, False, []), "cappedStatus": (2, 1, False, ["WHO KNOWS"]), "isPlayerOverseas": (2, 1, False, [])}
    assert dataset.promotion_report(df).collect() == [] and dataset.promoted(df.select(F.lit(1).alias("x")))[1] == []
