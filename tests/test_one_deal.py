"""Sums of innings deal their balls once."""

import datetime

from tidemark.plans import careers

BALLS = "match_id int, match_date date, innings int, over int, phase string, batter_id long, non_striker_id long, bowler_id int, player_out_id long, runs int, faced boolean, four boolean, six boolean, dot boolean, legal boolean, conceded int, bowler_wicket boolean, wides int, noballs int, leg_extras int"


def test_one_shuffle(spark):
    ball = lambda over, bat, bowl, runs, out=None: (1, datetime.date(2020, 1, 1), 1, over, "powerplay", bat, 3 - bat, bowl, out, runs, True, runs == 4, runs == 6, runs == 0, True, runs, out is not None, 0, 0, 0)
    rows = [ball(1, 1, 9, 0), ball(1, 1, 9, 0), ball(2, 1, 8, 4), ball(3, 2, 9, 0, 2), ball(3, 1, None, 6, 7)]
    made = careers.innings_sums(spark.createDataFrame(rows, BALLS))
    got = {r.entity: r for r in made.collect()}
    assert set(got) == {1, 2, 8, 9}  # 7 is out without being in
    assert (got[1].bat_in, got[1].bat_runs, got[1].bat_balls, got[1].bat_outs) == (5, 10, 4, 0) and got[2].bat_outs == 1
    assert (got[9].bowl_maidens, got[9].bowl_balls, got[9].bowl_wickets, got[8].bowl_maidens, got[8].bowl_runs) == (2, 3, 1, 0, 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = careers.innings_sums(spark.createDataFrame(rows, BALLS))
        assert str(again._jdf.queryExecution().executedPlan()).count("Exchange ") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
