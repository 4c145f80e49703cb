"""Players' statistics: sums by innings, careers and recent form as of a day, and their feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rates
from tidemark.functions.rates import PHASES
from tidemark.operators import checks, features

BAT = ("runs", "balls", "fours", "sixes", "dots", "outs", "control_balls", "controlled", "elev_balls", "aerial", *(f"{x}_{p}" for p in PHASES for x in ("runs", "balls", "boundaries")))
BOWL = ("balls", "runs", "wickets", "dots", "wides", "noballs", "maidens", "control_balls", "false_shots", "elev_balls", "aerial_conceded", *(f"{x}_{p}" for p in PHASES for x in ("balls", "runs", "wickets", "boundaries_conceded")))
FIELD = ("catches", "stumpings", "run_out_involvements")
EXPERIENCE = ("matches", "batting_matches", "bowling_matches", "batting_innings", "bowling_innings")
#: Columns that the feature rows have beside the rates.
BAT_FEATURES = ("runs", "balls", "fours", "sixes", "dots", "outs", *(f"{x}_{p}" for p in PHASES for x in ("runs", "balls")))
BOWL_FEATURES = ("balls", "runs", "wickets", "dots", "wides", "noballs", "maidens", *(f"{x}_{p}" for p in PHASES for x in ("balls", "runs", "wickets")))
SHOT_FLAGS = ("has_control", "is_controlled_wide", "has_elevation", "is_aerial")


def with_shots(deliveries: DataFrame, shots: DataFrame, keys: tuple[str, ...] = ("match_id", "innings", "ball_seq")) -> DataFrame:
    """Deliveries with the flags of their shots, null where a ball has none; a key repeated in shots fails the query."""
    return checks.join_checked(deliveries, shots.select(*keys, *SHOT_FLAGS), list(keys))


def innings_sums(deliveries: DataFrame) -> DataFrame:
    """Sums of each (entity, match_id, innings), with first_date: batting (bat_), bowling (bowl_), bat_in and bowl_in.

    Balls are dealt by player, a row for each part in it, before anything is summed, so that overs (for maidens),
    innings and a player's later sums by match and windows share that one shuffle of narrow rows.  A player is
    in as striker or non-striker; who is out without being in isn't counted out.  Flags of shots that
    the table lacks, or a ball has none of, add nothing to a rate's numerator or denominator.
    Deliveries without a date fail the query.
    """
    c, one = F.col, lambda x: F.coalesce(F.col(x).cast("int"), F.lit(0))
    d = deliveries.where(F.when(c("match_date").isNull(), F.raise_error(F.concat(F.lit("no date for match "), F.coalesce(c("match_id").cast("string"), F.lit("?"))))).otherwise(F.lit(True)))
    there = set(deliveries.columns)
    flag = {x: one(x) if x in there else F.lit(0) for x in SHOT_FLAGS}
    controlled, aerial = flag["has_control"] * flag["is_controlled_wide"], flag["has_elevation"] * flag["is_aerial"]
    boundary, by_phase = one("four") + one("six"), lambda who, adds: {f"{who}_{x}_{p}": F.when(c("phase") == p, v).otherwise(0) for p in PHASES for x, v in adds.items()}
    bat = {"bat_in": F.lit(1), "bat_runs": c("runs"), "bat_balls": one("faced"), "bat_fours": one("four"), "bat_sixes": one("six"), "bat_dots": one("dot"),
        "bat_control_balls": flag["has_control"], "bat_controlled": controlled, "bat_elev_balls": flag["has_elevation"], "bat_aerial": aerial,
        **by_phase("bat", {"runs": c("runs"), "balls": one("faced"), "boundaries": boundary})}
    nothing = F.coalesce((c("runs") == 0) & (c("leg_extras") == 0), F.lit(False)).cast("int")
    bowl = {"bowl_in": F.lit(1), "bowl_balls": one("legal"), "bowl_runs": c("conceded"), "bowl_wickets": one("bowler_wicket"), "bowl_dots": one("legal") * nothing, "bowl_wides": c("wides"), "bowl_noballs": c("noballs"),
        "bowl_control_balls": flag["has_control"], "bowl_false_shots": flag["has_control"] - controlled, "bowl_elev_balls": flag["has_elevation"], "bowl_aerial_conceded": aerial,
        **by_phase("bowl", {"balls": one("legal"), "runs": c("conceded"), "wickets": one("bowler_wicket"), "boundaries_conceded": boundary})}
    used = ["over", "phase", "runs", "faced", "four", "six", "dot", "legal", "conceded", "bowler_wicket", "wides", "noballs", "leg_extras", *(x for x in SHOT_FLAGS if x in there)]
    parties = F.posexplode(F.array("batter_id", "non_striker_id", "player_out_id", "bowler_id")).alias("_role", "entity")
    # who is only in, or out, needs nothing of the ball
    rows = d.select("match_id", "match_date", "innings", *used, parties).where("entity is not null")
    rows = rows.select("match_id", "match_date", "innings", "_role", "entity", *(F.when(c("_role").isin(0, 3), c(x)).alias(x) for x in used)).repartition("entity")
    at = lambda i, v: F.when(c("_role") == i, v).otherwise(0)
    adds = {**{n: at(0, v) for n, v in bat.items() if n != "bat_in"}, "bat_in": F.when(c("_role") < 2, 1).otherwise(0), "bat_outs": at(2, F.lit(1)), **{n: at(3, v) for n, v in bowl.items()}}
    own = lambda v: F.sum(F.when(c("_role") == 3, v))
    overs = rows.groupBy("entity", "match_id", "innings", "over").agg(*(F.sum(v).alias(n) for n, v in adds.items()), F.min("match_date").alias("first_date"), own(c("conceded")).alias("_c"), own(one("legal")).alias("_l"))
    maidens = F.sum(F.when((c("_c") == 0) & (c("_l") > 0), 1).otherwise(0)).alias("bowl_maidens")
    made = overs.groupBy("entity", "match_id", "innings").agg(*(F.sum(n).alias(n) for n in adds), F.min("first_date").alias("first_date"), maidens)
    made = made.withColumn("bat_outs", F.when(c("bat_in") > 0, c("bat_outs")).otherwise(0))
    numbers = ["bat_in", *(f"bat_{x}" for x in BAT), "bowl_in", *(f"bowl_{x}" for x in BOWL)]
    return made.where("bat_in > 0 or bowl_in > 0").select("entity", "match_id", "innings", "first_date", *(F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in numbers))


def fielding_sums(fielding: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Catches, stumpings and run-outs of each (entity, match_id), with first_date, for matches that have deliveries.

    Fielding in other matches is left out; in an innings without deliveries, of a match that has some,
    it fails the query, as the two were filtered differently.
    """
    dates = deliveries.groupBy("match_id", "innings").agg(F.min("match_date").alias("first_date"))
    there = fielding.where("fielder_id is not null").join(deliveries.select("match_id").distinct(), "match_id", "left_semi")
    kind = lambda k: F.sum((F.lower("kind") == k).cast("int"))
    sums = dict(zip(FIELD, map(kind, ("caught", "stumped", "run out")), strict=True))
    # summed before dates are looked up: one row a fielder and innings
    by_innings = there.groupBy(F.col("fielder_id").alias("entity"), "match_id", "innings").agg(*(F.coalesce(v, F.lit(0)).alias(n) for n, v in sums.items()))
    known = checks.join_known(by_innings, dates, ["match_id", "innings"], "first_date")
    return known.groupBy("entity", "match_id").agg(*(F.sum(n).alias(f"field_{n}") for n in FIELD), F.min("first_date").alias("first_date"))


def career(table: DataFrame, requests: DataFrame, fielding: DataFrame | None = None, recent: int | None = 20) -> DataFrame:
    """For each distinct request (entity, as_of) all totals and rates of matches on earlier days.

    table: innings_sums; fielding: fielding_sums.  Columns: has_history; exp_ matches and innings;
    bat_, bowl_ and field_ totals; the batter's and bowler's rates with the same prefixes, null
    without a denominator; and the same of the last ``recent`` matches that the player batted in
    (recent_bat_) or bowled in (recent_bowl_), which are each discipline's own.  An unknown entity
    has zeros.  Matches and requests go through windows of one partitioning by entity, a match
    being one row: a request sees the running sums of the rows before it, and what is recent is a
    range of the number of matches so far, in which requests and other matches count nothing.  Only
    entities that are asked for are summed, a semi-join that Catalyst moves below the folds.
    """
    wanted = requests.select("entity").distinct()
    table = table.join(wanted, "entity", "left_semi")
    bat, bowl, field = [f"bat_{x}" for x in BAT], [f"bowl_{x}" for x in BOWL], [f"field_{x}" for x in FIELD]
    batting, bowling = ["batting_matches", "bat_innings", *bat], ["bowling_matches", "bowl_innings", *bowl]
    numbers = ["matches", "innings", *batting, *bowling, *field]
    own = lambda x: F.sum((F.col(x) > 0).cast("int"))
    played = table.groupBy("entity", "match_id").agg(F.min("first_date").alias("first_date"), F.count("*").alias("innings"), own("bat_in").alias("bat_innings"), own("bowl_in").alias("bowl_innings"), *(F.sum(x).alias(x) for x in [*bat, *bowl]))
    played = played.withColumns({"matches": F.lit(1), "batting_matches": (F.col("bat_innings") > 0).cast("int"), "bowling_matches": (F.col("bowl_innings") > 0).cast("int")})
    if fielding is not None:
        played = played.unionByName(fielding.join(wanted, "entity", "left_semi").repartition("entity"), allowMissingColumns=True)
    place = ["entity", "_day", "_side", "_match", "as_of"]
    rows = played.withColumns({"_day": F.to_date("first_date"), "_side": F.lit(1), "_match": F.col("match_id"), "as_of": F.lit(None).cast(requests.schema["as_of"].dataType)})
    there = set(played.columns)  # asked once, as each time it costs a look at the plan
    rows = rows.select(*place, *((F.coalesce(F.col(n), F.lit(0)) if n in there else F.lit(0)).cast("long").alias(n) for n in numbers))
    asked = requests.select("entity", "as_of").distinct().withColumns({"_day": F.to_date("as_of"), "_side": F.lit(0), "_match": F.lit(None).cast(rows.schema["_match"].dataType)})
    asked = asked.repartition("entity").select(*place, *(F.lit(0).cast("long").alias(n) for n in numbers))  # as the matches are, so that the union is dealt already
    so_far = Window.partitionBy("entity").orderBy("_day", "_side", "_match").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked).withColumns({f"all_{n}": F.sum(n).over(so_far) for n in numbers})
    late = [*batting, *bowling] if recent else []
    for names in (batting, bowling) if recent else ():
        last = Window.partitionBy("entity").orderBy(f"all_{names[0]}").rangeBetween(1 - recent, 0)
        both = both.withColumns({f"recent_{n}": F.sum(n).over(last) for n in names})
    moved = {f"exp_{x}": F.col("all_" + {"batting_innings": "bat_innings", "bowling_innings": "bowl_innings"}.get(x, x)) for x in EXPERIENCE}
    done = both.where("_side = 0").select("entity", "as_of", (F.col("all_innings") > 0).alias("has_history"), *(v.alias(n) for n, v in moved.items()), *(F.col(f"all_{n}").alias(n) for n in [*batting[1:], *bowling[1:], *field]), *(f"recent_{n}" for n in late))
    of = [("bat", rates.batting), ("bowl", rates.bowling), *([("recent_bat", rates.batting), ("recent_bowl", rates.bowling)] if recent else [])]
    there = set(done.columns)
    return done.withColumns({f"{k}_{n}": v for k, made in of for n, v in made(f"{k}_").items() if f"{k}_{n}" not in there})


def feature_counts() -> dict[str, Column]:
    """The feature rows' totals: experience, batting, bowling, fielding.  Runs by phase are among the measures."""
    names = [*(f"exp_{x}" for x in EXPERIENCE), *(f"bat_{x}" for x in BAT_FEATURES), *(f"bowl_{x}" for x in BOWL_FEATURES), *(f"field_{x}" for x in FIELD)]
    measures = set(feature_measures())
    return {n: F.col(n) for n in names if n not in measures}


def feature_measures() -> dict[str, Column]:
    """The feature rows' rates, which have a flag each."""
    return {f"{k}_{n}": F.col(f"{k}_{n}") for k, of in (("bat", rates.batting), ("bowl", rates.bowling)) for n in of()}


def feature_columns() -> list[str]:
    """The fixed list of a feature row's numbers, in order."""
    return ["has_history", *feature_counts(), *(x for n in feature_measures() for x in (n, f"{n}_is_missing"))]


def feature_rows(made: DataFrame, fill: float = 0.0) -> DataFrame:
    """(entity, as_of) and the columns of feature_columns as doubles, from career()."""
    return features.flattened(made, ["entity", "as_of"], {"has_history": F.col("has_history"), **feature_counts()}, feature_measures(), fill)
