"""The state of an auction before each lot: teams' budgets and holdings, supply and demand of tags.

Lots are rows of an auction in order; a sold lot names its team and price and carries tags.
All states are sums over earlier or later lots, so they are windows; the largest table is that
of lots and teams, and one of lots, teams and tags where teams' holdings of tags are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["auction", "lot"]


def team_states(lots: DataFrame, teams: DataFrame, purse: float, slots: int, counts: dict[str, Column] | None = None) -> DataFrame:
    """(auction, lot, team, purse_left, slots_left, bought, each count) before the lot, for every lot and team.

    lots: auction, lot, team (null if not sold), price, and what the counts' conditions read.
    A sale without a price costs nothing.  teams has a column team, and is as short as a list of
    teams is.
    """
    own = F.coalesce(F.col("team") == F.col("_team"), F.lit(False))
    grid = lots.crossJoin(F.broadcast(teams.select(F.col("team").alias("_team")).distinct()))
    before = Window.partitionBy("auction", "_team").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(F.when(own, c).otherwise(0)).over(before), F.lit(0))
    made = {"purse_left": F.lit(purse) - so_far(F.coalesce(F.col("price"), F.lit(0.0))), "bought": so_far(F.lit(1)).cast("long")}
    made |= {name: so_far(c.cast("int")).cast("long") for name, c in (counts or {}).items()}
    done = grid.withColumns(made).withColumn("slots_left", F.lit(slots) - F.col("bought"))
    return done.select("auction", "lot", F.col("_team").alias("team"), "purse_left", "slots_left", "bought", *(counts or {}))


def tag_states(lots: DataFrame, states: DataFrame, targets: DataFrame, least_purse: float = 0.0) -> DataFrame:
    """(auction, lot, tag, supply, demand, scarcity) before each lot, for every tag of targets (tag, target).

    supply counts the lots from this one on that have the tag; demand the teams
    that hold fewer than the target and have a slot and the least purse.  Scarcity is demand over
    supply, of which 1 counts at least.
    """
    held = holdings(lots, states, targets)
    able = (F.col("slots_left") > 0) & (F.col("purse_left") >= least_purse)
    wanted = held.groupBy("auction", "lot", "tag").agg(F.sum(F.when(able & (F.col("bought") < F.col("target")), 1).otherwise(0)).alias("demand"))
    ahead = Window.partitionBy("auction", "tag").orderBy(F.desc("lot")).rowsBetween(Window.unboundedPreceding, 0)  # backwards, as a running sum
    has = F.coalesce(F.array_contains("tags", F.col("tag")), F.lit(False))
    left = lots.select(*KEYS, "tags").crossJoin(F.broadcast(targets.select("tag"))).withColumn("supply", F.coalesce(F.sum(has.cast("int")).over(ahead), F.lit(0)))
    both = left.select(*KEYS, "tag", "supply").join(wanted, [*KEYS, "tag"])
    return both.withColumn("scarcity", F.col("demand") / F.greatest(F.col("supply"), F.lit(1)))


def holdings(lots: DataFrame, states: DataFrame, targets: DataFrame) -> DataFrame:
    """states for each tag of targets, with bought (lots of the tag that the team has) and needed before the lot."""
    rows = states.select(*KEYS, "team", "purse_left", "slots_left").join(lots.select(*KEYS, F.col("team").alias("_buyer"), "tags"), KEYS).crossJoin(F.broadcast(targets))
    before = Window.partitionBy("auction", "team", "tag").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    got = F.coalesce((F.col("_buyer") == F.col("team")) & F.array_contains("tags", F.col("tag")), F.lit(False)).cast("int")
    done = rows.withColumn("bought", F.coalesce(F.sum(got).over(before), F.lit(0)))
    return done.withColumn("needed", F.greatest(F.col("target") - F.col("bought"), F.lit(0))).drop("_buyer", "tags")


def substitutes(lots: DataFrame) -> DataFrame:
    """(auction, lot, substitutes_remaining): lots from this one on that share a tag with it.

    Lots that hold one of several tags are counted by inclusion and exclusion: each lot has a row for
    every subset of its tags (lists of tags are short), and the lots ahead that hold a subset are a
    running sum read backwards.  Rows are as many as lots times subsets, whatever sets there are.
    """
    rows = lots.select(*KEYS, F.array_sort(F.array_compact(F.array_distinct("tags"))).alias("kind"))
    each = rows.where(F.size("kind") > 0).select(*KEYS, "kind", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(kind)) - 1"))).alias("mask"))
    each = each.select(*KEYS, F.expr("filter(kind, (t, i) -> (shiftright(mask, i) & 1) = 1)").alias("subset"))
    ahead = Window.partitionBy("auction", "subset").orderBy(F.desc("lot")).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    counted = each.withColumn("n", F.count("*").over(ahead)).groupBy(*KEYS).agg(F.sum(F.col("n") * sign).alias("substitutes_remaining"))
    return rows.select(*KEYS).join(counted, KEYS, "left").fillna(0, ["substitutes_remaining"])


def focus(lots: DataFrame, states: DataFrame, targets: DataFrame, least_purse: float = 0.0) -> DataFrame:
    """For every lot and team what they hold, need and face in the lot's own tags, in a fixed width.

    n_tags, substitutes_remaining, bought and needed (min, max, mean), supply (min, mean), demand
    and scarcity (max, mean), and wants_any, whether the team is short of one of the tags; also
    interested, the teams with a free slot that are.
    """
    own = lots.select(*KEYS, F.explode(F.array_distinct("tags")).alias("tag"))
    held = holdings(lots, states, targets).join(own, [*KEYS, "tag"])
    stats = lambda c, *which: [{"min": F.min, "max": F.max, "mean": F.avg}[w](c).alias(f"{c}_{w}") for w in which]
    team = held.groupBy(*KEYS, "team", "slots_left").agg(*stats("bought", "min", "max", "mean"), *stats("needed", "min", "max", "mean"), F.max((F.col("needed") > 0).cast("int")).alias("wants_any"))
    team = team.withColumn("interested", F.sum(F.when(F.col("slots_left") > 0, F.col("wants_any")).otherwise(0)).over(Window.partitionBy(*KEYS))).drop("slots_left")
    tags = tag_states(lots, states, targets, least_purse).join(own, [*KEYS, "tag"])
    lot = tags.groupBy(*KEYS).agg(F.count("*").alias("n_tags"), *stats("supply", "min", "mean"), *stats("demand", "max", "mean"), *stats("scarcity", "max", "mean"))
    return team.join(lot, KEYS).join(substitutes(lots), KEYS)


def numbered_bids(bids: DataFrame, lot: str, number: str, amount: str, row: str) -> DataFrame:
    """bids whose numbers are given or, in lots that lack one, counted from 1 by amount and then by row."""
    by = Window.partitionBy(lot)
    whole = F.count(number).over(by) == F.count("*").over(by)
    return bids.withColumn(number, F.when(whole, F.col(number)).otherwise(F.row_number().over(by.orderBy(amount, row)).cast("long")))
