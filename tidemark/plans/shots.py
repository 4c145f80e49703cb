"""Attributes of balls from a second feed: players, then matches, then balls are linked, each stage on the one before.

Feeds share no key but some of the players' numbers.  What is not told by such a key goes to the
next tier; matches are linked by day and by who played, balls by their place in an innings that
both feeds count alike.  That both name the same batter is the check on all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocabulary
from tidemark.operators import linkage
from tidemark.plans import identity
from tidemark.sources.io import shared_table


def source_players(balls: DataFrame) -> DataFrame:
    """(player_id, spelling, balls): each number of the feed with every name it bats or bowls under."""
    both = balls.select(F.col("p_bat").alias("player_id"), F.col("bat").alias("spelling")).unionAll(balls.select("p_bowl", "bowl"))
    return both.where("player_id is not null").groupBy("player_id", "spelling").agg(F.count("*").alias("balls"))


def player_crosswalk(balls: DataFrame, people: DataFrame, contexts: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(player_id, person_id, method, balls, display_name) of each number of the feed.

    people: person_id, key (null if unknown), variants.  A key that several people have tells of
    none.  Numbers without one are resolved by their names, with squads as evidence where contexts
    (player_id, season, franchise) and members (of ``identity.squads``) are given.  Of numbers that come to one person the key
    wins; a tie within a tier resolves none of them.  An unresolved number stays, with nulls.
    """
    names = shared_table(source_players(balls), "spellings")  # read by six branches; else conditions on names are asked of every ball
    every = names.groupBy("player_id").agg(F.sum("balls").alias("balls"), F.min("spelling").alias("display_name"))
    keyed = linkage.unique_only(people.where("key is not null").select(F.col("key").alias("player_id"), "person_id"), ["player_id"])
    first = every.join(keyed, "player_id").select("player_id", "person_id", F.lit("key").alias("method"), F.lit(0).alias("tier"))
    rest = names.join(first.select("player_id"), "player_id", "left_anti").where("trim(spelling) <> ''")
    ord_ = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("balls"), "spelling"))
    rest = rest.withColumn("ord", ord_)
    found = identity.alike(rest, identity.name_index(people), None if contexts is None else identity.seen_together(contexts, members))
    named = identity.resolve_players(rest, found).where("person_id is not null")
    second = named.select("player_id", "person_id", F.concat(F.lit("name:"), "method").alias("method"), F.lit(1).alias("tier"))
    told = linkage.strictest_unique(first.unionAll(second), "person_id", "tier").drop("tier")
    return every.join(told, "player_id", "left").select("player_id", "person_id", "method", "balls", "display_name")


def match_crosswalk(balls: DataFrame, players: DataFrame, deliveries: DataFrame, least: float = 0.35, runner_up: float = 0.8) -> DataFrame:
    """(p_match, match_id, jaccard, n_shared, status) of each match of the feed that has a known player.

    Candidates lie within a day.  Pairs are made by shared players alone, so days with many
    matches cost what their players share; no_candidate and no_overlap are told apart by the days.
    """
    known = players.where("person_id is not null").select("player_id", "person_id")
    # a row a match with those who played, written, as what follows reads it twice
    ours = balls.select("p_match", "date", F.explode(F.array("p_bat", "p_bowl")).alias("player_id")).join(known, "player_id")
    ours = shared_table(ours.groupBy("p_match").agg(F.to_date(F.min("date")).alias("day"), F.collect_set("person_id").alias("persons")), "ours")
    left = ours.select("p_match", "day", F.size("persons").alias("n"))
    theirs = deliveries.select("match_id", "match_date", F.explode(F.array("striker_id", "bowler_id")).alias("person_id")).where("person_id is not null")
    theirs = shared_table(theirs.groupBy("match_id").agg(F.to_date(F.min("match_date")).alias("day_r"), F.collect_set("person_id").alias("persons")), "theirs")
    days = F.explode(F.array(*(F.date_add("day", i) for i in (-1, 0, 1)))).alias("day_r")
    near = left.select("p_match", days).join(theirs.select("day_r").distinct(), "day_r").select("p_match").distinct().withColumn("_near", F.lit(True))
    asked = ours.where("day is not null").select("p_match", F.size("persons").alias("n"), "persons", days).withColumn("person_id", F.explode("persons")).drop("persons")
    met = asked.join(theirs.select("match_id", "day_r", F.size("persons").alias("n_r"), F.explode("persons").alias("person_id")), ["day_r", "person_id"])
    # dealt by our match, which counting, ranking and the join of the verdict all go by
    pairs = met.select("p_match", "match_id", "n", "n_r").repartition("p_match").groupBy("p_match", "match_id", "n", "n_r").agg(F.count("*").alias("overlap"))
    scored = pairs.select("p_match", "match_id", "overlap", (F.col("overlap") / (F.col("n") + F.col("n_r") - F.col("overlap"))).alias("score"))
    told = linkage.verdicts(left, scored, "p_match", "match_id", least, runner_up, F.col("day").isNotNull())
    told = told.join(near, "p_match", "left").withColumn("verdict", F.when((F.col("verdict") == "no_candidate") & F.col("_near"), "no_overlap").otherwise(F.col("verdict")))
    once = linkage.claim_once(told, "linked_match_id", [F.desc("score"), F.desc("overlap"), F.col("p_match")])
    return once.select("p_match", F.col("linked_match_id").alias("match_id"), F.coalesce("score", F.lit(0.0)).alias("jaccard"), F.coalesce("overlap", F.lit(0)).alias("n_shared"), F.col("verdict").alias("status"))


def ball_attributes(balls: DataFrame, players: DataFrame, matches: DataFrame, deliveries: DataFrame, carried: list[str], least: float = 0.95) -> DataFrame:
    """(match_id, innings, ball_seq, striker_id, bowler_id), carried and the shots' flags of balls that both feeds have.

    Innings of which the feeds count different numbers of balls are left out, as are balls whose
    batters differ; a batter unknown to the feed's crosswalk doesn't count.  If fewer than ``least`` of the known
    ones agree the order of the balls is wrong somewhere, and the query fails.
    """
    linked = matches.where("match_id is not null").select("p_match", "match_id")
    known = players.where("person_id is not null").select(F.col("player_id").alias("p_bat"), F.col("person_id").alias("source_striker"))
    own = ["control", "shot", "elevation", "binary", *carried]
    left = balls.join(linked, "p_match").join(known, "p_bat", "left").select("match_id", "innings", "ball_id", "source_striker", *own)
    right = deliveries.where("not super_over").join(linked, "match_id", "left_semi").select("match_id", "innings", "ball_seq", "striker_id", "bowler_id")
    both = linkage.positional_align(left, right, ["match_id", "innings"], [F.col("ball_id")], [F.col("ball_seq")])
    kept, gate = linkage.agreement(both, "source_striker", "striker_id", least)
    sure = gate.select(F.when(F.col("enough") | (F.col("share").isNull()), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the feeds agree on the batter of too few balls: "), F.col("share").cast("string")))).alias("_sure"))
    made = vocabulary.shot_flags(*(F.col(c) for c in ("control", "shot", "elevation", "binary")))
    rows = kept.crossJoin(F.broadcast(sure)).where("_sure")  # one row
    return rows.select("match_id", "innings", "ball_seq", "striker_id", "bowler_id", *carried, *(c.alias(n) for n, c in made.items()))
