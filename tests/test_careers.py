"""Careers, recent form and feature rows against sums by hand over every ball."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.rates import PHASES
from tidemark.plans import careers

FIELDS = "match_id long, match_date date, innings int, over int, ball_seq int, phase string, batter_id string, non_striker_id string, bowler_id string, player_out_id string, runs int, faced boolean, four boolean, six boolean, dot boolean, legal boolean, conceded int, bowler_wicket boolean, wides int, noballs int, leg_extras int"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
FIRST = dt.date(2020, 1, 1)


def balls(seed, matches=14):
    rnd, out = random.Random(seed), []
    for m in range(matches):
        day = FIRST + dt.timedelta(days=rnd.randrange(9))  # several matches share days
        for i in (1, 2):
            for n in range(rnd.randrange(0, 14)):
                wide, noball, runs = rnd.random() < 0.1, rnd.random() < 0.1, rnd.choice([0, 0, 1, 2, 4, 6])
                a, b, c = rnd.sample("abcdef", 3)
                gone = rnd.choice([None, None, a, b])
                out.append((m, day, i, n // 3, n, PHASES[n % 3], a, rnd.choice([b, b, None]), rnd.choice([c, c, c, None]), gone, runs, not wide, runs == 4, runs == 6, not wide and runs == 0, not wide and not noball, runs + wide + noball, gone == a, int(wide), int(noball), rnd.choice([0, 0, 1])))
    return out


def flags(rows, seed):
    rnd = random.Random(seed)
    told = lambda: rnd.choice([(1, 1.0), (1, 0.0), (0, None)])
    return [(r[0], r[2], r[4], *told(), *told()) for r in rows if rnd.random() < 0.8]


def by_hand(rows, shots, who, before):
    """{quantity: total} and the distinct matches and innings of each discipline."""
    shot = {s[:3]: s[3:] for s in shots}
    total, bat, bowl, over = {}, set(), set(), {}
    add = lambda n, v: total.__setitem__(n, total.get(n, 0) + v)
    rows = [dict(zip(NAMES, r, strict=True)) for r in rows]
    rows = [r for r in rows if r["match_date"] < before]
    for r in rows:
        at = (r["match_date"], r["match_id"], r["innings"])
        if who in (r["batter_id"], r["non_striker_id"]):
            bat.add(at)
        if who == r["bowler_id"]:
            bowl.add(at)
    for r in rows:
        at = (r["match_date"], r["match_id"], r["innings"])
        control, well, high, aerial = (int(x or 0) for x in shot.get((r["match_id"], r["innings"], r["ball_seq"]), (0, 0, 0, 0)))
        if r["batter_id"] == who:
            for n, v in (("runs", r["runs"]), ("balls", r["faced"]), ("fours", r["four"]), ("sixes", r["six"]), ("dots", r["dot"]), ("control_balls", control), ("controlled", control * well), ("elev_balls", high), ("aerial", high * aerial),
                         (f"runs_{r['phase']}", r["runs"]), (f"balls_{r['phase']}", r["faced"]), (f"boundaries_{r['phase']}", r["four"] + r["six"])):
                add(f"bat_{n}", int(v))
        if r["player_out_id"] == who and at in bat:
            add("bat_outs", 1)
        if r["bowler_id"] == who:
            o = over.setdefault((*at, r["over"]), [0, 0])
            o[0] += r["conceded"]
            o[1] += r["legal"]
            for n, v in (("balls", r["legal"]), ("runs", r["conceded"]), ("wickets", r["bowler_wicket"]), ("dots", r["legal"] and r["runs"] == 0 and r["leg_extras"] == 0), ("wides", r["wides"]), ("noballs", r["noballs"]),
                         ("control_balls", control), ("false_shots", control * (1 - well)), ("elev_balls", high), ("aerial_conceded", high * aerial),
                         (f"balls_{r['phase']}", r["legal"]), (f"runs_{r['phase']}", r["conceded"]), (f"wickets_{r['phase']}", r["bowler_wicket"]), (f"boundaries_conceded_{r['phase']}", r["four"] + r["six"])):
                add(f"bowl_{n}", int(v))
    add("bowl_maidens", sum(c == 0 and n > 0 for c, n in over.values()))
    return total, bat, bowl


@pytest.mark.parametrize("seed", [1, 2])
def test_careers_and_recent_form(spark, seed):
    rows = balls(seed)
    shots = flags(rows, seed)
    deliveries = spark.createDataFrame(rows, FIELDS)
    told = spark.createDataFrame(shots, "match_id long, innings int, ball_seq int, has_control int, is_controlled_wide double, has_elevation int, is_aerial double")
    table = careers.innings_sums(careers.with_shots(deliveries, told))
    asked = [(p, FIRST + dt.timedelta(days=d)) for p in "abcdefz" for d in (0, 3, 6, 30)]
    requests = spark.createDataFrame(asked + asked[:3], "entity string, as_of date")
    got = {(r["entity"], r["as_of"]): r for r in careers.career(table, requests, recent=3).collect()}
    assert sorted(got) == sorted(asked)
    for who, day in asked:
        r, (total, bat, bowl) = got[who, day], by_hand(rows, shots, who, day)
        names = [*(f"bat_{x}" for x in careers.BAT), *(f"bowl_{x}" for x in careers.BOWL)]
        assert {n: r[n] for n in names} == {n: total.get(n, 0) for n in names}
        count = lambda s: len({x[:2] for x in s})
        assert (r["has_history"], *(r[f"exp_{x}"] for x in careers.EXPERIENCE)) == (bool(bat | bowl), count(bat | bowl), count(bat), count(bowl), len(bat), len(bowl))
        share = lambda a, b, k=1.0: k * total.get(a, 0) / total[b] if total.get(b) else None
        near = lambda a, b: a == b if b is None or a is None else abs(a - b) < 1e-9
        assert near(r["bat_average"], share("bat_runs", "bat_outs")) and near(r["bat_control_percentage"], share("bat_controlled", "bat_control_balls"))
        assert near(r["bowl_economy_death"], share("bowl_runs_death", "bowl_balls_death", 6.0)) and near(r["bowl_aerial_conceded_percentage"], share("bowl_aerial_conceded", "bowl_elev_balls"))
        for k, own, n in (("bat", bat, "batting_matches"), ("bowl", bowl, "bowling_matches")):
            last = sorted({x[:2] for x in own})[-3:]
            recent = by_hand([x for x in rows if (x[1], x[0]) in last], shots, who, day)[0]
            assert r[f"recent_{n}"] == len(last)
            assert {x: r[f"recent_{x}"] for x in names if x.startswith(k + "_")} == {x: recent.get(x, 0) for x in names if x.startswith(k + "_")}


def test_fielding_and_features(spark):
    rows = balls(5, 4)
    deliveries = spark.createDataFrame(rows, FIELDS)
    table = careers.innings_sums(deliveries)
    m, day, i = rows[0][:3]
    fielding = [(m, i, "caught", "g"), (m, i, "Stumped", "g"), (m, i, "run out", "g"), (m, i, "caught", None), (m, i, "lbw", "a"), (99, 1, "caught", "g")]
    fields = "match_id long, innings int, kind string, fielder_id string"
    made = careers.fielding_sums(spark.createDataFrame(fielding, fields), deliveries)
    requests = spark.createDataFrame([("g", FIRST + dt.timedelta(days=60)), ("g", day), ("a", FIRST + dt.timedelta(days=60)), (None, day)], "entity string, as_of date")
    done = careers.career(table, requests, made, recent=None)
    got = {(r["entity"], r["as_of"]): r for r in done.collect()}
    g = got["g", FIRST + dt.timedelta(days=60)]
    # a fielder alone has no innings, hence no history
    assert (g["field_catches"], g["field_stumpings"], g["field_run_out_involvements"], g["has_history"], g["exp_matches"]) == (1, 1, 1, False, 0)
    assert got["g", day]["field_catches"] == 0 and got[None, day]["bat_runs"] == 0
    assert got["a", FIRST + dt.timedelta(days=60)]["bat_control_percentage"] is None  # no flags, no rate
    flat = careers.feature_rows(done, fill=-1.0)
    assert flat.columns == ["entity", "as_of", *careers.feature_columns()] and len(set(flat.columns)) == len(flat.columns)
    row = flat.where("entity = 'g'").first()
    assert (row["bat_average"], row["bat_average_is_missing"], row["bat_runs_death"], row["bat_runs_death_is_missing"]) == (-1.0, 1.0, 0.0, 0.0)
    assert all(isinstance(row[c], float) for c in careers.feature_columns())
    with pytest.raises(Exception, match="nothing is known of"):
        careers.fielding_sums(spark.createDataFrame([(m, 7, "caught", "g")], fields), deliveries).collect()


def test_empty_and_undated(spark):
    none = spark.createDataFrame([], FIELDS)
    requests = spark.createDataFrame([("a", FIRST)], "entity string, as_of date")
    (r,) = careers.career(careers.innings_sums(none), requests).collect()
    assert (r["has_history"], r["bat_runs"], r["recent_batting_matches"], r["bat_average"]) == (False, 0, 0, None)
    undated = spark.createDataFrame(balls(1, 2), FIELDS).withColumn("match_date", F.lit(None).cast("date"))
    with pytest.raises(Exception, match="no date for match"):
        careers.innings_sums(undated).collect()


def test_one_shuffle_of_careers(spark):
    table = spark.createDataFrame(careers.innings_sums(spark.createDataFrame(balls(1), FIELDS)).collect())
    requests = spark.createDataFrame([("a", FIRST)], "entity string, as_of date")
    plan = careers.career(table, requests)._jdf.queryExecution().executedPlan().toString().split("\n")
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    # running sums and both recent forms: sorted anew, never shuffled again
    assert len(windows) == 3
    assert not [line for line in plan[windows[0] : windows[-1]] if "Exchange" in line]
    # who is asked for, their matches, the requests, and both by entity
    assert sum("Exchange hashpartitioning(" in line for line in plan) <= 4
