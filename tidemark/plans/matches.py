"""Ingest of nested match documents: deliveries, wickets, fielding, appearances, people."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import careers

SCHEMA = """meta struct<data_version:string,created:string,revision:int>,
info struct<balls_per_over:int,overs:int,match_type:string,gender:string,team_type:string,season:string,dates:array<string>,
teams:array<string>,venue:string,city:string,event:struct<name:string>,toss:struct<winner:string,decision:string>,
outcome:struct<winner:string,result:string>,players:map<string,array<string>>,registry:struct<people:map<string,string>>>,
innings array<struct<team:string,super_over:boolean,target:struct<runs:int>,overs:array<struct<over:int,deliveries:array<struct<
batter:string,non_striker:string,bowler:string,runs:struct<batter:int,extras:int,total:int,non_boundary:boolean>,
extras:struct<wides:int,noballs:int,byes:int,legbyes:int,penalty:int>,
wickets:array<struct<kind:string,player_out:string,fielders:array<struct<name:string,substitute:boolean>>>>>>>>>>"""
#: Kinds of dismissal that a bowler is credited with, and those that are none.
BOWLERS = ("bowled", "caught", "caught and bowled", "lbw", "stumped", "hit wicket")
RETIRED = ("retired hurt", "retired not out")
PHASES = ("powerplay", "middle", "death")


@dataclass(frozen=True)
class Wanted:
    """Which matches count; an empty tuple lets all pass."""

    gender: tuple[str, ...] = ("male",)
    match_type: tuple[str, ...] = ("T20", "IT20")
    balls_per_over: tuple[int, ...] = (6,)
    overs: tuple[int, ...] = (20,)

    def passes(self, info: str = "doc.info") -> Column:
        out = F.size(f"{info}.dates") > 0
        for name in ("gender", "match_type", "balls_per_over", "overs"):
            values = getattr(self, name)
            if values:
                out = out & F.col(f"{info}.{name}").isin(*values)
        return F.coalesce(out, F.lit(False))


def phase(over: Column) -> Column:
    """The phase of an over, counted from 0."""
    return F.when(over <= 5, PHASES[0]).when(over <= 14, PHASES[1]).otherwise(PHASES[2])


def competition(info: str = "doc.info") -> Column:
    c = lambda x: F.nullif(F.trim(F.col(f"{info}.{x}")), F.lit(""))
    label = F.when(F.col(f"{info}.match_type") == "T20", "T20 International").when(F.col(f"{info}.match_type") == "IT20", "Other T20 International")
    return F.coalesce(c("event.name"), label, c("match_type"), F.lit("unknown"))


@dataclass
class Ingested:
    deliveries: DataFrame
    wickets: DataFrame
    fielding: DataFrame
    people: DataFrame
    failed: DataFrame


def ingest(docs: DataFrame, wanted: Wanted | None = None) -> Ingested:
    """The tables of parsed documents (doc_id, doc, error).

    A match of which a name isn't in its registry is in ``failed`` and nowhere else, and its
    people are known from other matches only; names of fielders may be unknown.  Super overs
    leave no deliveries, wickets or fielding.  A ball with several wickets is the bowler's, or
    puts the striker out, if any of them does.
    """
    chosen = docs.where("error is null").where((wanted or Wanted()).passes())
    people = F.col("doc.info.registry.people")
    head = [F.col("doc_id").alias("match_id"), F.to_date(F.col("doc.info.dates")[0]).alias("match_date"), competition().alias("competition"), F.col("doc.info.season").alias("season"), people.alias("_people")]
    innings = chosen.select(*head, F.posexplode("doc.innings").alias("_i", "inn"))
    overs = innings.select("match_id", "match_date", "competition", "season", "_people", (F.col("_i") + 1).alias("innings"), F.coalesce("inn.super_over", F.lit(False)).alias("super_over"), F.posexplode("inn.overs").alias("_o", "ov"))
    balls = overs.select("match_id", "match_date", "competition", "season", "_people", "innings", "super_over", F.col("_o"), F.col("ov.over").alias("over"), F.posexplode("ov.deliveries").alias("_b", "d"))
    who = lambda name: F.col("_people")[name]
    order = Window.partitionBy("match_id", "innings").orderBy("_o", "_b")
    extra = lambda x: F.coalesce(F.col(f"d.extras.{x}"), F.lit(0))
    boundary = ~F.coalesce("d.runs.non_boundary", F.lit(False))
    noted = F.coalesce("d.wickets", F.array().cast("array<struct<kind:string,player_out:string,fielders:array<struct<name:string,substitute:boolean>>>>"))
    wickets = F.transform(noted, lambda w: w.withField("kind", F.lower(F.trim(w["kind"]))))
    real = F.filter("wickets", lambda w: ~w["kind"].isin(*RETIRED))
    first = F.coalesce(F.get(F.filter("wickets", lambda w: ~w["kind"].isin(*RETIRED)), F.lit(0)), F.get("wickets", F.lit(0)))
    rows = balls.select(
        "match_id", "match_date", "competition", "season", "innings", "super_over", "over", "_people",
        (F.col("_b") + 1).alias("ball_in_over"), (F.row_number().over(order) - 1).alias("ball_seq"), phase(F.col("over")).alias("phase"),
        *(F.col(f"d.{n}").alias(f"_{n}") for n in ("batter", "non_striker", "bowler")),
        who(F.col("d.batter")).alias("batter_id"), who(F.col("d.non_striker")).alias("non_striker_id"), who(F.col("d.bowler")).alias("bowler_id"),
        F.col("d.runs.batter").alias("runs"), F.col("d.runs.total").alias("total"), extra("wides").alias("wides"), extra("noballs").alias("noballs"),
        (extra("byes") + extra("legbyes")).alias("leg_extras"), (extra("wides") == 0).alias("faced"), ((extra("wides") == 0) & (extra("noballs") == 0)).alias("legal"),
        (F.col("d.runs.batter") + extra("wides") + extra("noballs")).alias("conceded"),
        ((F.col("d.runs.batter") == 4) & boundary).alias("four"), ((F.col("d.runs.batter") == 6) & boundary).alias("six"), wickets.alias("wickets"),
    )
    rows = rows.withColumns({"dot": F.col("faced") & (F.col("runs") == 0), "n_out": F.size(real), "_first": first})
    rows = rows.withColumns({
        "wicket_kind": F.col("_first.kind"), "player_out_id": F.when(~F.col("_first.kind").isin(*RETIRED), who(F.col("_first.player_out"))),
        "bowler_wicket": F.coalesce(F.exists("wickets", lambda w: w["kind"].isin(*BOWLERS)), F.lit(False)),
        "batter_dismissed": F.coalesce(F.exists("wickets", lambda w: (w["player_out"] == F.col("_batter")) & ~w["kind"].isin(*RETIRED)), F.lit(False)),
    })
    before = Window.partitionBy("match_id", "innings").orderBy("ball_seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumns({"runs_before": so_far("total"), "wickets_before": so_far("n_out"), "balls_before": so_far(F.col("legal").cast("int"))})
    unknown = F.col("batter_id").isNull() | F.col("non_striker_id").isNull() | F.col("bowler_id").isNull() | F.exists("wickets", lambda w: F.col("_people")[w["player_out"]].isNull())
    lost = rows.where(unknown).groupBy("match_id").agg(F.lit("a name isn't in the registry").alias("error"))
    failed = docs.where("error is not null").select(F.col("doc_id").alias("match_id"), "error").unionByName(lost)
    good = rows.where(~F.col("super_over")).join(lost.select("match_id"), "match_id", "left_anti")
    out = good.select("match_id", "innings", "over", "ball_seq", "bowler_id", "_people", F.explode("wickets").alias("w"))
    wicket_rows = out.select("match_id", "innings", "over", "ball_seq", "bowler_id", F.col("w.kind").alias("kind"), who(F.col("w.player_out")).alias("player_out_id"), F.col("w.kind").isin(*BOWLERS).alias("bowler_credited"))
    fielding = out.select("match_id", "innings", "ball_seq", F.col("w.kind").alias("kind"), F.explode("w.fielders").alias("f"), "_people").select("match_id", "innings", "ball_seq", "kind", F.col("f.name").alias("fielder"), F.try_element_at("_people", F.col("f.name")).alias("fielder_id"), F.coalesce("f.substitute", F.lit(False)).alias("substitute"))
    names = chosen.join(lost.select(F.col("match_id").alias("doc_id")), "doc_id", "left_anti").select(F.explode(people).alias("name", "person_id"))
    persons = names.groupBy("person_id").agg(F.array_sort(F.collect_set("name")).alias("_v"), F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"))
    persons = persons.select("person_id", "name", F.array_join("_v", "|").alias("variants"), F.size("_v").cast("long").alias("n_variants"))
    return Ingested(good.drop("_people", "_first", "_batter", "_non_striker", "_bowler", "super_over", "wickets"), wicket_rows, fielding, persons, failed)


def invariants(made: Ingested) -> DataFrame:
    """(check, value): numbers that are all 0 in a sound ingest."""
    from tidemark.operators.checks import findings

    d = F.col
    return findings(made.deliveries, {
        "no_batter": ("error", d("batter_id").isNull()), "no_bowler": ("error", d("bowler_id").isNull()), "no_date": ("error", d("match_date").isNull()),
        "negative_runs": ("error", d("runs") < 0), "four_and_six": ("error", d("four") & d("six")), "legal_wide": ("error", d("legal") & (d("wides") > 0)), "dot_with_runs": ("error", d("dot") & (d("runs") > 0)),
    })


def innings_table(made: Ingested, shots: DataFrame | None = None) -> DataFrame:
    """careers.innings_sums of the deliveries, with the flags of shots where there are any."""
    return careers.innings_sums(made.deliveries if shots is None else careers.with_shots(made.deliveries, shots))
