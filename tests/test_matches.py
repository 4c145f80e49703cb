"""Three matches of our own making with every kind of ball, and the sums worked out by hand."""

import json
import zipfile

import pytest

from pyspark.sql import functions as F
from tidemark.plans import careers, matches
from tidemark.sources import io

FIRST, SECOND, THIRD = "north-south", "south-east", "tied"
PEOPLE = {"Ana": "p1", "Bea": "p2", "Cleo": "p3", "Dora": "p4", "Edda": "p5"}


def ball(striker, partner, bowler, runs=0, out=(), **extra):
    rope = extra.pop("ran_all", False)
    d = {"batter": striker, "non_striker": partner, "bowler": bowler, "runs": {"batter": runs, "extras": sum(extra.values()), "total": runs + sum(extra.values())}}
    if rope:
        d["runs"]["non_boundary"] = True
    if extra:
        d["extras"] = extra
    if out:
        d["wickets"] = [{"kind": kind, "player_out": who, **({"fielders": [{"name": by}]} if by else {})} for kind, who, by in out]
    return d


def document(day, people, innings, **info):
    told = {"balls_per_over": 6, "overs": 20, "match_type": "T20", "gender": "male", "season": "2021/22", "dates": [day], "teams": ["North", "South"], "registry": {"people": people}}
    return {"meta": {"revision": 2}, "info": told | info, "innings": innings}


def inning(overs, **more):
    return {"team": "North", "overs": [{"over": n, "deliveries": balls} for n, balls in overs.items()], **more}


#: Dora bowls to Ana and Bea in over 2; Cleo comes in.  In over 16 Edda has a maiden but for byes.
NORTH = document("2021-12-05", PEOPLE, [
    inning({
        2: [
            ball("Ana", "Bea", "Dora", 1),
            ball("Bea", "Ana", "Dora", 6),
            ball("Bea", "Ana", "Dora", noballs=1, byes=2),
            ball("Bea", "Ana", "Dora", wides=3),
            ball("Bea", "Ana", "Dora", 4, ran_all=True),
            ball("Bea", "Ana", "Dora", out=[(" Caught ", "Bea", "Edda"), ("retired hurt", "Ana", None)]),
        ],
        16: [ball("Cleo", "Ana", "Edda", byes=1), ball("Ana", "Cleo", "Edda", penalty=5), ball("Ana", "Cleo", "Edda", out=[("retired not out", "Ana", None), ("bowled", "Ana", None)])],
    }),
    inning({0: [ball("Dora", "Edda", "Ana", 6)]}, super_over=True),
])
SOUTH = document("2021-12-09", {"Ana K": "p1", "Bea": "p9", "Dora": "p4"}, [inning({7: [ball("Ana K", "Bea", "Dora", 2), ball("Ana K", "Bea", "Dora", 3), ball("Bea", "Ana K", "Dora", out=[("run out", "Ana K", "Unknown")])]})], match_type="IT20", event={"name": ""})
LOST = document("2021-12-10", {"Zoe": "p8"}, [inning({0: [ball("Zoe", "Nobody", "Zoe", 1)]})])
TOO_SHORT = document("2021-12-11", PEOPLE, [inning({0: [ball("Ana", "Bea", "Dora", 1)]})], overs=10)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("matches")
    with zipfile.ZipFile(folder / "season.zip", "w") as z:
        for name, doc in ((FIRST, NORTH), (SECOND, SOUTH), ("lost", LOST), ("short", TOO_SHORT)):
            z.writestr(f"{name}.json", json.dumps(doc))
        z.writestr("README.json", "{}")
        z.writestr("cut.json", '{"info": ')
    (folder / "bad.zip").write_bytes(b"zip?")
    return matches.ingest(io.parsed(io.documents(spark, str(folder)), matches.SCHEMA))


def test_balls(made):
    rows = {(r.match_id, r.ball_seq): r for r in made.deliveries.collect()}
    assert len(rows) == 12  # the super over left none
    noball, wide, ran, both, bye = (rows[FIRST, i] for i in (2, 3, 4, 5, 6))
    assert (noball.faced, noball.legal, noball.conceded) == (True, False, 1)
    assert (wide.faced, wide.legal, wide.conceded) == (False, False, 3)
    assert (ran.four, ran.runs) == (False, 4) and rows[FIRST, 1].six
    assert (both.wicket_kind, both.bowler_wicket, both.batter_dismissed, both.n_out) == ("caught", True, True, 1)
    assert (bye.faced, bye.legal, bye.conceded, bye.dot) == (True, True, 0, True)
    last = rows[FIRST, 8]
    assert (last.wicket_kind, last.bowler_wicket, last.batter_dismissed, last.phase) == ("bowled", True, True, "death")
    assert [rows[FIRST, i].runs_before for i in range(9)] == [0, 1, 7, 10, 13, 17, 17, 18, 23]
    assert [rows[FIRST, i].balls_before for i in range(9)] == [0, 1, 2, 2, 2, 3, 4, 5, 6]
    assert rows[FIRST, 8].wickets_before == 1
    assert {r.competition for r in rows.values()} == {"T20 International", "Other T20 International"}


def test_wickets(made):
    got = sorted((r.match_id, r.ball_seq, r.kind, r.player_out_id, r.bowler_credited) for r in made.wickets.collect())
    assert got == [
        (FIRST, 5, "caught", "p2", True), (FIRST, 5, "retired hurt", "p1", False), (FIRST, 8, "bowled", "p1", True), (FIRST, 8, "retired not out", "p1", False), (SECOND, 2, "run out", "p1", False),
    ]
    assert {(r.fielder, r.fielder_id) for r in made.fielding.collect()} == {("Edda", "p5"), ("Unknown", None)}


def test_failed_and_people(made):
    assert {r.match_id for r in made.failed.collect()} == {"lost", "cut", "bad.zip"}
    people = {r.person_id: (r.name, r.variants) for r in made.people.collect()}
    assert people == {"p1": ("Ana K", "Ana|Ana K"), "p2": ("Bea", "Bea"), "p3": ("Cleo", "Cleo"), "p4": ("Dora", "Dora"), "p5": ("Edda", "Edda"), "p9": ("Bea", "Bea")}
    assert all(r.value == 0 for r in matches.invariants(made).collect())


def test_career(spark, made):
    asked = [("p1", "2021-12-05"), ("p1", "2021-12-06"), ("p1", "2022-01-01"), ("p2", "2022-01-01"), ("p4", "2021-12-09"), ("p4", "2021-12-10"), ("p5", "2022-01-01"), ("p7", "2022-01-01")]
    requests = spark.createDataFrame(asked, "entity string, d string").select("entity", F.to_date("d").alias("as_of"))
    got = {(r.entity, str(r.as_of)): r for r in careers.career(matches.innings_table(made), requests).collect()}
    pick = lambda who, day, *cols: tuple(got[who, day][c] for c in cols)
    assert pick("p1", "2021-12-05", "has_history", "bat_balls") == (False, 0)
    # one run off a ball in over 2, then a penalty ball and the last one in over 16, out once
    assert pick("p1", "2021-12-06", "bat_runs", "bat_balls", "bat_outs", "bat_runs_powerplay", "bat_balls_death", "exp_matches") == (1, 3, 1, 1, 2, 1)
    assert pick("p1", "2022-01-01", "bat_runs", "bat_balls", "bat_outs", "bat_average", "exp_matches", "exp_batting_innings") == (6, 5, 2, 3.0, 2, 2)
    # Bea faces five of six balls: 6, no-ball, 4 run, out; the wide isn't faced
    assert pick("p2", "2022-01-01", "bat_runs", "bat_balls", "bat_fours", "bat_sixes", "bat_outs", "bat_strike_rate") == (10, 4, 0, 1, 1, 250.0)
    assert pick("p4", "2021-12-09", "bowl_balls", "bowl_runs", "bowl_wickets", "bowl_wides", "bowl_noballs", "bowl_dots", "bowl_maidens") == (4, 15, 1, 3, 1, 1, 0)
    assert pick("p4", "2021-12-10", "bowl_balls", "bowl_runs", "bowl_wickets", "bowl_dots") == (7, 20, 1, 2)
    # byes and penalties are not the bowler's; a bye ends a dot, a penalty doesn't
    assert pick("p5", "2022-01-01", "bowl_balls", "bowl_runs", "bowl_wickets", "bowl_dots", "bowl_maidens") == (3, 0, 1, 2, 1)
    assert pick("p7", "2022-01-01", "has_history", "bat_runs", "bat_average") == (False, 0, None)


def test_fielding(made):
    (r,) = careers.fielding_sums(made.fielding, made.deliveries).collect()
    assert (r.entity, r.field_catches, r.field_run_out_involvements, r.field_stumpings) == ("p5", 1, 0, 0)
