"""Attributes of balls of two small feeds: every tier, verdict and gate."""

import datetime

import pytest

from tidemark.plans import shots

PEOPLE = [("p1", 11, "Alan Border"), ("p2", 12, "Brian Lara"), ("p3", 12, "Carl Hooper"), ("p4", None, "Dennis Lillee"), ("p5", None, "Ed Smith|Edward Smith"), ("p6", None, "Frank Ward")]
SOURCE = "p_match int, date date, innings int, ball_id int, p_bat int, bat string, p_bowl int, bowl string, control string, shot string, elevation string, binary double, line string"
BALLS = "match_id string, match_date date, innings int, ball_seq int, striker_id string, bowler_id string, super_over boolean"
DAY = datetime.date(2020, 4, 1)


def source_ball(match, ball, bat, bowl, day=DAY, **more):
    names = {11: "A Border", 12: "Brian Lara", 13: "Carl Hooper", 14: "Dennis Lillee", 15: "Edward Smith", 16: "Ed Smith", 19: "Frank Ward", 20: " ", 99: "Nobody Here"}
    return (match, day, 1, ball, bat, names[bat], bowl, names[bowl], more.get("control"), more.get("shot"), more.get("elevation"), more.get("binary"), f"line {ball}")


def ball(match, seq, bat, bowl, day=DAY, extra=False):
    return (match, day, 1, seq, bat, bowl, extra)


@pytest.fixture
def feeds(spark):
    source = [source_ball(1, i, (11, 14)[i % 2], 12, control="well timed" if i else None, elevation="in the air") for i in range(4)]
    source += [source_ball(2, i, 11, 14, DAY + datetime.timedelta(1)) for i in range(2)]  # claims the same match less strongly
    source += [source_ball(3, 0, 11, 12, None), source_ball(4, 0, 11, 14, DAY + datetime.timedelta(400)), source_ball(5, 0, 19, 20), source_ball(6, 0, 99, 15), source_ball(6, 1, 16, 20)]
    theirs = [ball("m1", i, ("p1", "p4")[i % 2], "p2") for i in range(4)] + [ball("m1", 9, "p1", "p2", extra=True)] + [ball("m9", 0, "p3", "p7")]
    return spark.createDataFrame(source, SOURCE), spark.createDataFrame(PEOPLE, "person_id string, key int, variants string"), spark.createDataFrame(theirs, BALLS)


def test_players(feeds):
    got = {r.player_id: (r.person_id, r.method) for r in shots.player_crosswalk(feeds[0], feeds[1]).collect()}
    assert got[11] == ("p1", "key") and got[12] == ("p2", "name:exact")  # two people share its key
    assert got[14] == ("p4", "name:exact") and got[19] == ("p6", "name:exact")
    assert got[15] == got[16] == got[20] == got[99] == (None, None)  # both 15 and 16 come to p5


def test_key_beats_name(spark, feeds):
    twice = feeds[0].unionAll(spark.createDataFrame([(7, DAY, 1, 0, 77, "Alan Border", 14, "Dennis Lillee", None, None, None, None, "")], SOURCE))
    got = {r.player_id: r.person_id for r in shots.player_crosswalk(twice, feeds[1]).collect()}
    assert got[11] == "p1" and got[77] is None


def test_matches(feeds):
    players = shots.player_crosswalk(feeds[0], feeds[1]).cache()
    got = {r.p_match: (r.match_id, round(r.jaccard, 3), r.n_shared, r.status) for r in shots.match_crosswalk(feeds[0], players, feeds[2]).collect()}
    assert got == {1: ("m1", 1.0, 3, "ok"), 2: (None, 0.667, 2, "duplicate_claim"), 3: (None, 0.0, 0, "no_date"), 4: (None, 0.0, 0, "no_candidate"), 5: (None, 0.0, 0, "no_overlap")}
    assert {r.status for r in shots.match_crosswalk(feeds[0], players, feeds[2], least=0.7).where("p_match = 2").collect()} == {"weak"}


def test_balls_and_their_gate(spark, feeds):
    source, people, theirs = feeds
    players = shots.player_crosswalk(source, people).cache()
    matches = shots.match_crosswalk(source, players, theirs).cache()
    got = shots.ball_attributes(source, players, matches, theirs, ["line"]).orderBy("ball_seq").collect()
    assert [(r.ball_seq, r.striker_id, r.line, r.is_controlled, r.is_aerial) for r in got] == [(0, "p1", "line 0", None, None)] + [(i, ("p1", "p4")[i % 2], f"line {i}", 1.0, 1.0) for i in (1, 2, 3)]
    swapped = theirs.replace({"p1": "p4", "p4": "p1"}, subset=["striker_id"])
    with pytest.raises(Exception, match="too few balls"):
        shots.ball_attributes(source, players, matches, swapped, []).collect()
    short = theirs.where("ball_seq <> 3")  # another number of balls: the innings is left out
    assert shots.ball_attributes(source, players, matches, short, []).count() == 0
