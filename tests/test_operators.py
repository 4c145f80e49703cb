"""Goldens of operators that the catalogue's tables don't reach."""

import math

import pytest

from pyspark.sql import functions as F
from tidemark.functions import exprs, names, normal, vocabulary
from tidemark.operators import asof, checks, encode, linkage, market, replay, tags
from tidemark.operators.order import infeasibility, lot_order, repaired_order


def labels(spark, lots, bids, teams=("A", "B", "C")):
    lots = spark.createDataFrame(lots, "lot int, declared string, price double, base double, status string")
    bids = spark.createDataFrame(bids, "lot int, team string, no int, amt double")
    teams = spark.createDataFrame([(t,) for t in teams], "team string")
    return {(r.lot, r.team): (r.label, r.lower, r.upper, r.winner) for r in replay.interval_labels(lots, teams, bids, "lot", "team", "no", "amt").collect()}


def test_labels_of_an_auction(spark):
    """Two bidders who drive each other up, a sale at the base price, a lot nobody wanted, one bid on and left."""
    lots = [(11, "Red", 45.0, 10.0, "SOLD"), (12, "Blue", 8.0, 8.0, "Sold"), (13, None, None, 30.0, "UNSOLD"), (14, None, None, 12.0, "unsold"), (15, "Grey", 26.0, 25.0, "RTM"), (16, "Red", 5.0, 5.0, "TRADED")]
    bids = [(11, "Blue", 1, 10.0), (11, "Red", 2, 15.0), (11, "Blue", 3, 40.0), (11, "Red", 4, 45.0), (12, "Blue", 1, 8.0), (14, "Grey", 1, 12.0), (15, "Red", 1, 25.0), (15, "Grey", 2, 26.0)]
    got = labels(spark, lots, bids, ("Red", "Blue", "Grey"))
    none = lambda base: ("left", 0.01, base, False)
    assert got == {
        (11, "Red"): ("right", 45.0, 90.0, True), (11, "Blue"): ("interval", 40.0, 45.0, False), (11, "Grey"): none(10.0),
        (12, "Blue"): ("right", 8.0, 16.0, True), (12, "Red"): none(8.0), (12, "Grey"): none(8.0),
        (13, "Red"): none(30.0), (13, "Blue"): none(30.0), (13, "Grey"): none(30.0),
        (14, "Grey"): ("unknown", None, None, False), (14, "Red"): none(12.0), (14, "Blue"): none(12.0),
        (15, "Grey"): ("right", 26.0, 52.0, True), (15, "Red"): ("interval", 25.0, 26.0, False), (15, "Blue"): none(25.0),
    }


@pytest.mark.parametrize("lot, bids, want", [
    (("C", 20.0, "RTM"), [("A", 10.0), ("B", 20.0)], {"C": ("right", 20, 40, True), "B": ("right", 20, 40, False), "A": ("interval", 10, 20, False)}),
    (("A", 20.0, "SOLD"), [("A", 10.0), ("B", 20.0), ("A", 20.0)], {"B": ("right", 20, 40, False), "A": ("right", 20, 40, True)}),
    (("B", 15.0, "SOLD"), [("A", 10.0), ("B", 10.0), ("B", 15.0)], {"A": ("interval", 10, 15, False)}),
    (("B", 35.0, "SOLD"), [("A", 10.0), ("B", 20.0), ("A", 30.0)], {"A": ("unknown", None, None, False)}),
    ((None, None, "UNSOLD"), [("A", 10.0)], {"A": ("unknown", None, None, False), "B": ("left", 0.01, 5.0, False)}),
    (("A", 10.0, "RETAINED"), [], {"A": None}),
])
def test_label_edges(spark, lot, bids, want):
    got = labels(spark, [(1, lot[0], lot[1], 5.0, lot[2])], [(1, t, i, a) for i, (t, a) in enumerate(bids)])
    for team, label in want.items():
        assert got.get((1, team)) == label


def test_money(spark):
    texts = ["1.5 Cr", "1,050", "27 Crore", "30 L", " 20 lakh", "abc", None, "2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.e) for r in df.select("i", exprs.auction_money(F.col("t")).alias("a"), exprs.earnings_money(F.col("t")).alias("e")).collect()}
    assert [got[i][0] for i in range(8)] == [150.0, 1050.0, 2700.0, 30.0, 20.0, None, None, 2.0]
    assert [got[i][1] for i in range(8)] == [150.0, 1050.0, None, 30.0, None, None, None, 2.0]


def test_names(spark):
    df = spark.createDataFrame([("José  O'Neil-Smith",), ("MS Dhoni",), ("AB de Villiers",)], "n string")
    rows = [r for r in df.select(names.normal_name(F.col("n")).alias("normal"), names.signatures(F.col("n")).alias("s"), names.given_names(names.tokens(F.col("n"))).alias("g")).collect()]
    assert rows[0].normal == "jose oneilsmith" and rows[0].s == ["oneilsmith j", "smith jo"] and rows[0].g == ["jose"]
    assert rows[1].s == ["dhoni ms"] and rows[1].g == []
    assert rows[2].s == ["villiers ab"]
    particles = spark.createDataFrame([("Anna von der Berg", "berg a"), ("Rui dos Reis", "reis r"), ("DA Costa", "costa da"), ("Omar bin Said", "said ob"), ("Ali Al Noor", "noor aa"), ("Jan ten Op Dam", "dam j")], "n string, want string")
    assert all(r.got == r.want for r in particles.select("want", names.signature(names.tokens(F.col("n"), plain=True)).alias("got")).collect())
    pairs = spark.createDataFrame([("ak", "abck", True), ("ka", "abck", False), ("", "x", True)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in pairs.select("want", names.subsequence(F.col("a"), F.col("b")).alias("got")).collect())


def test_resolve(spark):
    rows = [(1, "p", 0, False, False), (1, "q", 2, True, False), (2, "p", 2, True, False), (2, "q", 2, False, False), (3, "p", 3, False, True), (3, "q", 3, False, False), (4, "p", 1, False, False), (4, "q", 1, False, False), (5, "p", 2, False, False), (5, "q", 2, False, False), (5, "r", 3, True, False)]
    got = {r.k: (r.person, r.method) for r in linkage.resolve(spark.createDataFrame(rows, "k int, person string, tier int, e boolean, x boolean"), "k", "person", "tier", "e", "x").collect()}
    assert got == {1: ("p", "exact"), 2: ("p", "signature+squad"), 3: ("p", "initials_subset+prefix"), 4: (None, "ambiguous"), 5: ("r", "signature+squad")}


def test_normal_tails(spark):
    rows = spark.createDataFrame([(-30.0,), (-2.0,), (0.0,), (3.0,)], "z double").select(normal.normal_cdf("z").alias("c"), normal.log_normal_cdf("z").alias("l")).collect()
    assert rows[2].c == 0.5 and rows[1].c == pytest.approx(0.0227501319, rel=1e-8)
    assert rows[0].l == pytest.approx(-454.3212439, rel=1e-8)
    nll = spark.createDataFrame([(1.0, math.e, 0.0, 1.0, 1.0), (50.0, 100.0, 0.0, 1.0, 0.0)], "a double, b double, m double, s double, w double")
    got = normal.weighted_nll(nll, "a", "b", "m", "s", "w").first().nll
    assert got == pytest.approx(-math.log(0.3413447461), rel=1e-6)


def test_assertions(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="key is repeated"):
        checks.join_checked(df.select("k"), df, ["k"]).count()
    with pytest.raises(Exception, match="nothing is known"):
        checks.join_known(spark.createDataFrame([(9,)], "k int"), df, ["k"], "v").count()
    codes = encode.vocabulary(df.where("k = 1"), "v")
    with pytest.raises(Exception, match="unknown"):
        encode.label_encode(df, "v", codes, "c").collect()
    assert checks.bad_intervals(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (0.0, 1.0), (1.0, None)], "a double, b double"), "a", "b").count() == 3


def test_scale(spark):
    df = spark.createDataFrame([(float(i), float(i**4)) for i in range(50)] + [(None, 1.0)], "a double, b double")
    params = encode.scaler_params(df, ["a", "b"])
    assert {r.feature: r.log for r in params.collect()} == {"a": False, "b": True}
    done = encode.scale(df, params)
    assert done.where("a_is_missing = 1").first().a == 0.0
    assert abs(done.where("a_is_missing = 0").agg(F.avg("a")).first()[0]) < 1e-9


def test_tags(spark):
    df = spark.createDataFrame([(1, True, True, False, None), (2, None, None, True, True), (3, None, None, None, None)], "k int, opener boolean, top boolean, pace boolean, left_arm boolean")
    got = tags.tag_table(df, "k", ["opener", "top"], {"pace_left": F.coalesce(F.col("pace") & F.col("left_arm"), F.lit(False))})
    assert {(r.k, r.tag) for r in got.collect()} == {(1, "opener"), (1, "top"), (2, "pace_left"), (3, "untagged")}
    assert tags.exactly_one(df, "pace", ["left_arm"]).count() == 0
    demand = tags.demand(spark.createDataFrame([("A", "x", 2)], "team string, tag string, n int"), spark.createDataFrame([("A",), ("B",), ("C",)], "team string"), "team", spark.createDataFrame([("x", 2), ("y", 1)], "tag string, target int"))
    found = {r.tag: (r.demand, r.scarcity) for r in tags.scarcity(demand, spark.createDataFrame([("y", 6)], "tag string, supply int")).collect()}
    assert found == {"x": (2, 2.0), "y": (3, 0.5)}


def test_asof_is_strict(spark):
    left = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 30.0), ("a", 4, 40.0), ("a", 4, 41.0), ("b", 1, 1.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v_before for r in asof.asof_join(left, right, "k", "t", {"v_before": "v"}, [F.col("v")]).collect()}
    assert got == {("a", 5): 41.0, ("a", 3): None, ("b", 1): None}


def test_lot_order(spark):
    df = spark.createDataFrame([(1, "x", 3, 30.0), (2, "y", 2, 20.0), (3, "z", 1, 10.0)], "pos int, name string, lot_no int, price double")
    ordered, method = lot_order(df, "pos")
    assert method == "lot_no" and [r.name for r in ordered.orderBy("lot").collect()] == ["z", "y", "x"]
    ordered, method = lot_order(df.drop("lot_no"), "pos")
    assert method == "reverse_file_order" and [r.name for r in ordered.orderBy("lot").collect()] == ["z", "y", "x"]


def test_order_repair(spark):
    # the dearest lot is stamped last, when its buyer's purse is gone
    lots = [("a", 0, "X", 10.0), ("a", 1, "X", 20.0), ("a", 2, "Y", 5.0), ("a", 3, "X", 70.0)]
    bids = [("a", 3, "Y", 97.0)]
    lots_df = spark.createDataFrame(lots, "auction string, lot int, team string, price double")
    bids_df = spark.createDataFrame(bids, "auction string, lot int, bidder string, amount double")
    before = infeasibility(lots_df, bids_df, 100.0).first().shortfall
    fixed = repaired_order(lots_df, bids_df, 100.0)
    renamed = bids_df.join(fixed.select("auction", F.col("old_lot").alias("lot"), F.col("lot").alias("new")), ["auction", "lot"]).drop("lot").withColumnRenamed("new", "lot")
    assert before == 2.0 and infeasibility(fixed, renamed, 100.0).first().shortfall == 0.0


def test_loud_checks(spark):
    """What must not pass in silence fails with a message."""
    df = spark.createDataFrame([(1, 5.0, 7.0), (2, 7.0, 6.0)], "k int, lower double, upper double")
    with pytest.raises(ValueError, match="not in all tables: lower, upper"):
        checks.concat_strict([df, df.select("k")])
    with pytest.raises(ValueError, match="no row has k"):
        checks.restricted(df, "k", [9])
    with pytest.raises(ValueError, match=r"\(7.0, 6.0\)"):
        checks.sound_intervals(df, "lower", "upper")
    assert checks.sound_intervals(df.where("k = 1"), "lower", "upper").count() == 1
    roles = spark.createDataFrame([("WK-Batsman", "WICKETKEEPER"), ("batting all-rounder", "ALL-ROUNDER"), ("umpire", None), (None, None)], "r string, want string")
    assert all(r.got == r.want for r in roles.select("want", vocabulary.canonical_role(F.col("r"), strict=False).alias("got")).collect())
    with pytest.raises(Exception, match="no role is known as"):
        roles.select(vocabulary.canonical_role(F.col("r"))).collect()


def test_recent_matches(spark):
    """Two matches on a day are two; a match's innings are one; a request sees earlier days only."""
    rows = [("a", "2020-01-01", "m1", 1), ("a", "2020-01-01", "m2", 10), ("a", "2020-01-01", "m2", 20), ("a", "2020-01-03", "m3", 100), ("b", "2020-01-02", "m4", 5)]
    df = spark.createDataFrame(rows, "k string, d string, m string, p int").withColumn("d", F.to_date("d"))
    asked = spark.createDataFrame([("a", "2020-01-01"), ("a", "2020-01-02"), ("a", "2020-01-04"), ("b", "2021-01-01"), ("c", "2021-01-01"), ("a", "2020-01-04")], "k string, at string").withColumn("at", F.to_date("at"))
    got = sorted((r.k, str(r.at), r.matches, r.total) for r in asof.recent_of(df, asked, "k", "d", "m", "at", 2, {"total": F.col("p")}).collect())
    assert got == [("a", "2020-01-01", 0, 0), ("a", "2020-01-02", 2, 31), ("a", "2020-01-04", 2, 130), ("a", "2020-01-04", 2, 130), ("b", "2021-01-01", 1, 5), ("c", "2021-01-01", 0, 0)]


def test_market_states(spark):
    lots = spark.createDataFrame([(1, 1, "R", 60.0, ["x"]), (1, 2, None, None, ["x", "y"]), (1, 3, "B", None, ["y"]), (1, 4, "R", 30.0, ["z"])], "auction int, lot int, team string, price double, tags array<string>")
    teams, targets = spark.createDataFrame([("R",), ("B",)], "team string"), spark.createDataFrame([("x", 1), ("y", 1)], "tag string, target int")
    states = market.team_states(lots, teams, 100.0, 2)
    got = {(r.lot, r.team): (r.purse_left, r.slots_left) for r in states.collect()}
    assert got == {(1, "R"): (100, 2), (1, "B"): (100, 2), (2, "R"): (40, 1), (2, "B"): (100, 2), (3, "R"): (40, 1), (3, "B"): (100, 2), (4, "R"): (40, 1), (4, "B"): (100, 1)}
    told = {(r.lot, r.tag): (r.supply, r.demand, r.scarcity) for r in market.tag_states(lots, states, targets, 50.0).collect()}
    assert told[1, "x"] == (2, 2, 1.0) and told[2, "x"] == (1, 1, 1.0) and told[4, "y"] == (0, 0, 0.0) and told[3, "x"] == (0, 1, 1.0)
    block = {(r.lot, r.team): r for r in market.focus(lots, states, targets, 50.0).collect()}
    assert set(block) == {(i, t) for i in (1, 2, 3) for t in "RB"}  # lot 4 has no tag with a target
    r = block[2, "R"]
    assert (r.bought_min, r.bought_max, r.needed_max, r.wants_any, r.interested, r.n_tags, r.substitutes_remaining) == (0, 1, 1, 1, 2, 2, 2)
    bids = spark.createDataFrame([(1, 2, 5.0, 1), (1, 1, 4.0, 2), (2, None, 3.0, 3), (2, 7, 2.0, 4)], "lot int, no long, amt double, row int")
    assert {r.row: r.no for r in market.numbered_bids(bids, "lot", "no", "amt", "row").collect()} == {1: 2, 2: 1, 3: 2, 4: 1}


def test_next_greater_and_last_two(spark):
    rows = [("a", i, v) for i, v in enumerate([3.0, 1.0, None, 2.0, 5.0, 5.0, 4.0])] + [("b", 0, 1.0), ("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(3)
    got = {(r.k, r.i): r.next_greater for r in replay.next_greater(df, ["k"], [F.col("i")], "v").collect()}
    assert got == {("a", 0): 5.0, ("a", 1): 2.0, ("a", 2): None, ("a", 3): 5.0, ("a", 4): None, ("a", 5): None, ("a", 6): None, ("b", 0): None, ("c", 0): None}
    two = replay.last_two(df.withColumn("base", F.lit(0.5)), ["k"], [F.col("i")], "v", "base")
    assert {r.k: (r.last_value, r.previous_value) for r in two.collect()} == {"a": (4.0, 5.0), "b": (1.0, 0.5), "c": (None, 0.5)}
