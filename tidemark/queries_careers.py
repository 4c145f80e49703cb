"""The catalogue, fifth part: innings sums, careers, recent form and feature rows of line items read as balls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.rates import PHASES
from tidemark.plans import careers
from tidemark.queries import query

# orders are matches, line items balls, suppliers batters, parts bowlers

BALLS = """WITH d AS (SELECT l_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END AS innings, l_linenumber AS over, CASE WHEN l_linenumber <= 2 THEN 'powerplay' WHEN l_linenumber <= 4 THEN 'middle' ELSE 'death' END AS phase,
    l_suppkey AS batter_id, CASE WHEN l_quantity % 3 > 0 THEN abs(l_partkey - l_suppkey) END AS non_striker_id, CASE WHEN l_partkey % 17 > 0 THEN l_partkey END AS bowler_id, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity % 2 = 0 THEN l_suppkey ELSE abs(l_partkey - l_suppkey) END END AS player_out_id,
    CAST(l_quantity AS BIGINT) % 7 AS runs, l_tax > 0 AS faced, CAST(l_quantity AS BIGINT) % 7 = 4 AS four, CAST(l_quantity AS BIGINT) % 7 = 6 AS six, l_tax > 0 AND CAST(l_quantity AS BIGINT) % 7 = 0 AS dot, l_discount > 0 AS legal, CAST(l_quantity AS BIGINT) % 7 + (l_tax = 0)::INT AS conceded, l_returnflag = 'R' AS bowler_wicket,
    (l_tax = 0)::BIGINT AS wides, (l_discount = 0)::BIGINT AS noballs, (l_discount = 0.05)::BIGINT AS leg_extras, (l_tax > 0.02)::BIGINT AS has_control, (l_tax > 0.05)::BIGINT AS well, (l_discount > 0.02)::BIGINT AS has_elevation, (l_discount > 0.06)::BIGINT AS aerial FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_BAT = {"runs": "runs", "balls": "faced::BIGINT", "fours": "four::BIGINT", "sixes": "six::BIGINT", "dots": "dot::BIGINT", "control_balls": "has_control", "controlled": "has_control * well", "elev_balls": "has_elevation", "aerial": "has_elevation * aerial"}
_BOWL = {"balls": "legal::BIGINT", "runs": "conceded", "wickets": "bowler_wicket::BIGINT", "dots": "(legal AND runs = 0 AND leg_extras = 0)::BIGINT", "wides": "wides", "noballs": "noballs", "control_balls": "has_control", "false_shots": "has_control * (1 - well)", "elev_balls": "has_elevation", "aerial_conceded": "has_elevation * aerial"}
for _p in PHASES:
    _of = lambda v, p=_p: f"CASE WHEN phase = '{p}' THEN {v} ELSE 0 END"
    _BAT |= {f"runs_{_p}": _of("runs"), f"balls_{_p}": _of("faced::BIGINT"), f"boundaries_{_p}": _of("(four OR six)::BIGINT")}
    _BOWL |= {f"balls_{_p}": _of("legal::BIGINT"), f"runs_{_p}": _of("conceded"), f"wickets_{_p}": _of("bowler_wicket::BIGINT"), f"boundaries_conceded_{_p}": _of("(four OR six)::BIGINT")}
_SUMS = [*(f"bat_{x}" for x in careers.BAT), *(f"bowl_{x}" for x in careers.BOWL)]
_total = lambda names: ", ".join(f"coalesce(sum({n}), 0)::BIGINT AS {n}" for n in names)
# each role summed for itself, then put side by side
INNINGS = (
    BALLS
    + f""", k AS (SELECT DISTINCT entity, match_id, innings, match_date FROM (SELECT batter_id AS entity, match_id, innings, match_date FROM d UNION ALL SELECT non_striker_id, match_id, innings, match_date FROM d UNION ALL SELECT bowler_id, match_id, innings, match_date FROM d) WHERE entity IS NOT NULL),
    s1 AS (SELECT batter_id AS entity, match_id, innings, count(*) AS n1, {", ".join(f"sum({v}) AS bat_{n}" for n, v in _BAT.items())} FROM d GROUP BY ALL), s2 AS (SELECT non_striker_id AS entity, match_id, innings, count(*) AS n2 FROM d GROUP BY ALL),
    s3 AS (SELECT player_out_id AS entity, match_id, innings, count(*) AS bat_outs FROM d GROUP BY ALL), s4 AS (SELECT bowler_id AS entity, match_id, innings, count(*) AS n4, {", ".join(f"sum({v}) AS bowl_{n}" for n, v in _BOWL.items())} FROM d GROUP BY ALL),
    s5 AS (SELECT entity, match_id, innings, count_if(c = 0 AND l > 0) AS bowl_maidens FROM (SELECT bowler_id AS entity, match_id, innings, over, sum(conceded) AS c, sum(legal::INT) AS l FROM d GROUP BY ALL) GROUP BY ALL),
    i AS (SELECT entity, match_id, innings, match_date AS first_date, (coalesce(n1, 0) + coalesce(n2, 0))::BIGINT AS bat_in, coalesce(n4, 0)::BIGINT AS bowl_in, CASE WHEN n1 > 0 OR n2 > 0 THEN coalesce(bat_outs, 0) ELSE 0 END::BIGINT AS bat_outs, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in _SUMS if n != "bat_outs")}
      FROM k LEFT JOIN s1 USING (entity, match_id, innings) LEFT JOIN s2 USING (entity, match_id, innings) LEFT JOIN s3 USING (entity, match_id, innings) LEFT JOIN s4 USING (entity, match_id, innings) LEFT JOIN s5 USING (entity, match_id, innings)) """
)
DAYS = ("1995-06-30", "1996-12-31", "1998-07-01")
CAREERS = (
    INNINGS
    + f""", q AS (SELECT s_suppkey AS entity, unnest([{", ".join(f"DATE '{x}'" for x in DAYS)}]) AS as_of FROM supplier),
    m AS (SELECT entity, match_id, min(first_date) AS day, count(*) AS n_in, count_if(bat_in > 0) AS bat_innings, count_if(bowl_in > 0) AS bowl_innings, {", ".join(f"sum({n}) AS {n}" for n in _SUMS)} FROM i GROUP BY ALL),
    f AS (SELECT q.entity, as_of, count(*) AS field_catches FROM q JOIN (SELECT l_partkey AS fielder, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') x ON fielder = q.entity AND day < as_of GROUP BY ALL),
    c AS (SELECT q.entity, q.as_of, coalesce(sum(n_in), 0) > 0 AS has_history, count(m.match_id) AS exp_matches, count_if(bat_innings > 0) AS exp_batting_matches, count_if(bowl_innings > 0) AS exp_bowling_matches, coalesce(sum(bat_innings), 0)::BIGINT AS bat_innings, coalesce(sum(bowl_innings), 0)::BIGINT AS bowl_innings,
      {_total(_SUMS)} FROM q LEFT JOIN m ON m.entity = q.entity AND m.day < q.as_of GROUP BY ALL) """
)


def _of(scale: str, num: str, den: str) -> str:
    return f"round({scale} * ({num}) / nullif({den}, 0), 6)"


def _rates(w: str) -> dict[str, str]:
    """SQL of every rate of columns with the prefix w."""
    b, o = f"{w}bat_", f"{w}bowl_"
    r = {f"{b}average": _of("1.0", f"{b}runs", f"{b}outs"), f"{b}strike_rate": _of("100.0", f"{b}runs", f"{b}balls"), f"{b}boundary_percentage": _of("1.0", f"{b}fours + {b}sixes", f"{b}balls"), f"{b}dot_ball_percentage": _of("1.0", f"{b}dots", f"{b}balls"), f"{b}balls_per_dismissal": _of("1.0", f"{b}balls", f"{b}outs"),
        f"{b}runs_per_innings": _of("1.0", f"{b}runs", f"{b}innings"), f"{b}control_percentage": _of("1.0", f"{b}controlled", f"{b}control_balls"), f"{b}false_shot_percentage": _of("1.0", f"{b}control_balls - {b}controlled", f"{b}control_balls"), f"{b}aerial_percentage": _of("1.0", f"{b}aerial", f"{b}elev_balls"),
        f"{o}economy": _of("6.0", f"{o}runs", f"{o}balls"), f"{o}average": _of("1.0", f"{o}runs", f"{o}wickets"), f"{o}strike_rate": _of("1.0", f"{o}balls", f"{o}wickets"), f"{o}dot_ball_percentage": _of("1.0", f"{o}dots", f"{o}balls"), f"{o}wickets_per_innings": _of("1.0", f"{o}wickets", f"{o}innings"),
        f"{o}extras_per_ball": _of("1.0", f"{o}wides + {o}noballs", f"{o}balls"), f"{o}false_shot_percentage": _of("1.0", f"{o}false_shots", f"{o}control_balls"), f"{o}control_conceded_percentage": _of("1.0", f"{o}control_balls - {o}false_shots", f"{o}control_balls"), f"{o}aerial_conceded_percentage": _of("1.0", f"{o}aerial_conceded", f"{o}elev_balls")}
    for p in PHASES:
        r |= {f"{b}strike_rate_{p}": _of("100.0", f"{b}runs_{p}", f"{b}balls_{p}"), f"{b}balls_share_{p}": _of("1.0", f"{b}balls_{p}", f"{b}balls"), f"{b}boundary_percentage_{p}": _of("1.0", f"{b}boundaries_{p}", f"{b}balls_{p}"),
            f"{o}economy_{p}": _of("6.0", f"{o}runs_{p}", f"{o}balls_{p}"), f"{o}balls_share_{p}": _of("1.0", f"{o}balls_{p}", f"{o}balls"), f"{o}strike_rate_{p}": _of("1.0", f"{o}balls_{p}", f"{o}wickets_{p}"), f"{o}boundary_percentage_{p}": _of("1.0", f"{o}boundaries_conceded_{p}", f"{o}balls_{p}")}
    return r


def _balls(t):
    c, q = F.col, F.col("l_quantity").cast("long")
    tied = F.abs(c("l_partkey") - c("l_suppkey"))
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey"))
    return rows.select(c("l_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"), F.when(c("l_linestatus") == "F", 2).otherwise(1).alias("innings"), c("l_linenumber").alias("over"), F.when(c("l_linenumber") <= 2, "powerplay").when(c("l_linenumber") <= 4, "middle").otherwise("death").alias("phase"),
        c("l_suppkey").alias("batter_id"), F.when(c("l_quantity") % 3 > 0, tied).alias("non_striker_id"), F.when(c("l_partkey") % 17 > 0, c("l_partkey")).alias("bowler_id"), F.when(c("l_returnflag") == "R", F.when(c("l_quantity") % 2 == 0, c("l_suppkey")).otherwise(tied)).alias("player_out_id"),
        (q % 7).alias("runs"), (c("l_tax") > 0).alias("faced"), (q % 7 == 4).alias("four"), (q % 7 == 6).alias("six"), ((c("l_tax") > 0) & (q % 7 == 0)).alias("dot"), (c("l_discount") > 0).alias("legal"), (q % 7 + (c("l_tax") == 0).cast("long")).alias("conceded"), (c("l_returnflag") == "R").alias("bowler_wicket"),
        (c("l_tax") == 0).cast("long").alias("wides"), (c("l_discount") == 0).cast("long").alias("noballs"), (c("l_discount") == 0.05).cast("long").alias("leg_extras"),
        (c("l_tax") > 0.02).alias("has_control"), (c("l_tax") > 0.05).cast("double").alias("is_controlled_wide"), (c("l_discount") > 0.02).alias("has_elevation"), (c("l_discount") > 0.06).cast("double").alias("is_aerial"), c("l_partkey").alias("fielder_id"))


def _careers(t, recent=None):
    balls = _balls(t)
    table = careers.innings_sums(balls)
    caught = balls.where("bowler_wicket").select("match_id", "innings", F.lit("caught").alias("kind"), "fielder_id")
    asked = t("supplier").select(F.col("s_suppkey").alias("entity"), F.explode(F.array(*(F.lit(x).cast("date") for x in DAYS))).alias("as_of"))
    return careers.career(table, asked, None if recent else careers.fielding_sums(caught, balls), recent)


def _rounded(made, names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query(INNINGS + f"SELECT entity, match_id, innings, first_date, bat_in, bowl_in, {', '.join(_SUMS)} FROM i")
def q118_innings_sums(t):
    return careers.innings_sums(_balls(t))


@query(CAREERS + f"SELECT entity, as_of, has_history, exp_matches, exp_batting_matches, exp_bowling_matches, bat_innings AS exp_batting_innings, bowl_innings AS exp_bowling_innings, coalesce(field_catches, 0)::BIGINT AS field_catches, {', '.join(_SUMS)}, {', '.join(f'{v} AS {n}' for n, v in _rates('').items())} FROM c LEFT JOIN f USING (entity, as_of)")
def q119_careers(t):
    made = _careers(t)
    return made.select("entity", "as_of", "has_history", *(f"exp_{x}" for x in careers.EXPERIENCE), "field_catches", *_SUMS, *_rounded(made, _rates("")))


_LATE = {"bat": "batting_matches", "bowl": "bowling_matches"}
_RECENT = ", ".join(
    f"r{k} AS (SELECT q.entity, q.as_of, count(day) AS recent_{n}, coalesce(sum({k}_innings), 0) AS recent_{k}_innings, {', '.join(f'coalesce(sum({x}), 0)::BIGINT AS recent_{x}' for x in _SUMS if x.startswith(k + '_'))} FROM q LEFT JOIN (SELECT q.as_of AS asked, m.*, row_number() OVER (PARTITION BY q.entity, q.as_of ORDER BY m.day DESC, m.match_id DESC) AS nth FROM q JOIN m ON m.entity = q.entity AND m.day < q.as_of WHERE m.{k}_innings > 0) x ON x.entity = q.entity AND x.asked = q.as_of AND nth <= 5 GROUP BY ALL)"
    for k, n in _LATE.items()
)


@query(CAREERS + f", {_RECENT} SELECT entity, as_of, recent_batting_matches, recent_bowling_matches, {', '.join(f'recent_{x}' for x in _SUMS)}, {', '.join(f'{v} AS {n}' for n, v in _rates('recent_').items())} FROM rbat JOIN rbowl USING (entity, as_of)")
def q120_recent_form(t):
    made = _careers(t, 5)
    return made.select("entity", "as_of", "recent_batting_matches", "recent_bowling_matches", *(f"recent_{x}" for x in _SUMS), *_rounded(made, _rates("recent_")))


_COUNTED = ", ".join(f"{x}::DOUBLE AS {x}" for x in [*(f"bat_{x}" for x in careers.BAT_FEATURES), *(f"bowl_{x}" for x in careers.BOWL_FEATURES)])
_FLAGGED = ", ".join(f"coalesce({v}, 0.0)::DOUBLE AS {n}, ({v} IS NULL)::INT::DOUBLE AS {n}_is_missing" for n, v in _rates("").items())


@query(CAREERS + f"""SELECT entity, as_of, has_history::INT::DOUBLE AS has_history, exp_matches::DOUBLE AS exp_matches, exp_batting_matches::DOUBLE AS exp_batting_matches, exp_bowling_matches::DOUBLE AS exp_bowling_matches, bat_innings::DOUBLE AS exp_batting_innings, bowl_innings::DOUBLE AS exp_bowling_innings,
    coalesce(field_catches, 0)::DOUBLE AS field_catches, 0.0::DOUBLE AS field_stumpings, 0.0::DOUBLE AS field_run_out_involvements, {_COUNTED}, {_FLAGGED}, {", ".join(f"0.0::DOUBLE AS {k}_runs_{p}_is_missing" for k in ("bat", "bowl") for p in PHASES)} FROM c LEFT JOIN f USING (entity, as_of)""")
def q121_career_features(t):
    made = careers.feature_rows(_careers(t))
    return made.select("entity", "as_of", *(F.round(c, 6).alias(c) for c in careers.feature_columns()))
