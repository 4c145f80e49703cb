"""Who a roster's names are: candidates by tiers of evidence, squads, overrides, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import linkage


def _keyed(df: DataFrame, spelling: str) -> DataFrame:
    """df with own, the spelling's given names, and a row for each k (kind, tier, key, initials) of it: exact, normalised, signatures, surnames.

    Each step is a column, as words are looked at many times and parted once.
    """
    one = lambda kind, tier, key, initials: F.struct(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), key.alias("key"), initials.alias("initials"))
    part = lambda s, i: F.get(F.split(s, " "), F.lit(i))
    words = df.withColumn("_plain", names.unaccented(F.col(spelling))).withColumns({"_joined": names.tokens(F.col("_plain"), "", True), "_split": names.tokens(F.col("_plain"), " ", True)})
    signed = words.withColumns({"_signed": F.array_distinct(F.array(names.signature(F.col("_joined")), names.signature(F.col("_split")))), "_normal": F.lower(F.array_join("_joined", " ")), "own": names.given_names(F.col("_joined"))})
    keys = F.concat(F.array(one("exact", 0, F.trim(spelling), F.lit("")), one("normalised", 1, F.col("_normal"), F.lit(""))), F.transform("_signed", lambda s: one("signature", 2, s, part(s, 1))), F.transform("_signed", lambda s: one("surname", 3, part(s, 0), part(s, 1))))
    return signed.select(*df.columns, "own", F.explode_outer(keys).alias("k"))  # never empty; explode would add a filter that makes keys again


def name_index(people: DataFrame) -> DataFrame:
    """(kind, tier, key, initials, person_id, given) of people (person_id, variants parted by |)."""
    each = people.select("person_id", F.explode(F.split("variants", r"\|")).alias("v"))
    keyed = _keyed(each, "v")
    given = keyed.groupBy("person_id").agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("given"))
    return keyed.select("person_id", "k.*").where("key is not null and key <> ''").distinct().join(given, "person_id")


def _asked(roster: DataFrame, *more: str) -> DataFrame:
    return _keyed(roster.select("player_id", "spelling", *more), "spelling").select("player_id", "spelling", *more, "own", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), F.col("k.initials").alias("asked"))


def _fits(met: DataFrame) -> DataFrame:
    loose = F.col("tier") >= 2
    initials = (F.col("tier") < 3) | ((F.length("asked") > 0) & names.subsequence(F.col("asked"), F.col("initials")))
    return met.where(~loose | names.given_agree(F.col("own"), F.col("given"))).where(initials).withColumn("_prefix", (F.length("asked") > 0) & F.col("initials").startswith(F.col("asked")))


def candidates(roster: DataFrame, index: DataFrame) -> DataFrame:
    """(player_id, spelling, person_id, tier, prefix): whom each spelling may mean, by the strictest tier.

    Signatures and surnames must not contradict spelled-out given names.  A surname counts if
    the spelling's initials come up, in order, among the candidate's; prefix is whether the
    candidate's initials begin with them.  A row for each pair: where names are common use ``alike``.
    """
    fits = _fits(_asked(roster).join(index, ["kind", "key"]))
    return fits.groupBy("player_id", "spelling", "person_id").agg(F.min("tier").alias("tier"), F.coalesce(F.max("_prefix"), F.lit(False)).alias("prefix"))


def alike(roster: DataFrame, index: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(player_id, spelling, person_id, last_id, tier, prefix, evidence): ``candidates`` as ranges, for resolve_players.

    Persons whom the index tells apart by nothing are one row from the least to the greatest, and equal
    questions are asked once, so that a name of n players and n persons is one pair of rows and not n x n.
    Pairs that are ``seen`` (player_id, person_id, once each) have rows of their own, with evidence.
    """
    question, what = _asked(roster), ["kind", "key", "asked", "own"]
    classes = index.groupBy("kind", "tier", "key", "initials", "given").agg(F.min("person_id").alias("person_id"), F.max("person_id").alias("last_id"))
    fits = _fits(question.select(*what).distinct().join(classes, ["kind", "key"]))
    told = fits.groupBy(*what, "tier", F.col("_prefix").alias("prefix")).agg(F.min("person_id").alias("person_id"), F.max("last_id").alias("last_id"))
    found = question.join(told, what).select("player_id", "spelling", "person_id", "last_id", "tier", "prefix", F.lit(False).alias("evidence"))
    if seen is None:
        return found
    backed = _fits(_asked(roster.join(seen, "player_id"), "person_id").join(index, ["kind", "key", "person_id"]))
    return found.unionAll(backed.select("player_id", "spelling", "person_id", F.col("person_id").alias("last_id"), "tier", F.col("_prefix").alias("prefix"), F.lit(True).alias("evidence")))


def squads(appearances: DataFrame, aliases: DataFrame) -> DataFrame:
    """(season, franchise, person_id): who appeared for any of a franchise's names in a season (its first four characters)."""
    season = F.substring("season", 1, 4)
    return appearances.withColumn("season", season).join(F.broadcast(aliases), "team").select("season", "franchise", "person_id").distinct()


def seen_together(contexts: DataFrame, members: DataFrame) -> DataFrame:
    """(player_id, person_id): persons in a squad of one of the player's contexts (player_id, season, franchise)."""
    return contexts.withColumn("season", F.substring("season", 1, 4)).join(members, ["season", "franchise"]).select("player_id", "person_id").distinct()


def with_evidence(found: DataFrame, contexts: DataFrame, members: DataFrame) -> DataFrame:
    """found with evidence: the person is in a squad of one of the player's contexts (player_id, season, franchise)."""
    return found.join(seen_together(contexts, members).withColumn("evidence", F.lit(True)), ["player_id", "person_id"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(False)))


def resolve_players(roster: DataFrame, found: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(player_id, person_id, method) of each player of a roster (player_id, spelling, ord).

    Blocked and mapped overrides (player_id, person_id, action) come first.  Then spellings are
    resolved one by one: one person gives the method of the first spelling that told; several
    are a conflict unless the evidence is for one; none is ambiguous if a spelling was, else
    unresolved.
    """
    key = F.struct("player_id", "spelling")
    each = linkage.resolve(found.withColumn("k", key), "k", "person_id", "tier", "evidence" if "evidence" in found.columns else None, "prefix", "last_id" if "last_id" in found.columns else None).select("k.*", "person_id", "method")
    told = roster.join(each, ["player_id", "spelling"], "left")
    backed = found.where("evidence").select("player_id", "person_id").distinct().withColumn("backed", F.lit(True)) if "evidence" in found.columns else None
    told = told.join(backed, ["player_id", "person_id"], "left") if backed is not None else told.withColumn("backed", F.lit(None).cast("boolean"))
    one = told.groupBy("player_id").agg(F.collect_set("person_id").alias("p"), F.collect_set(F.when(F.col("backed"), F.col("person_id"))).alias("b"), F.min_by("method", F.when(F.col("person_id").isNotNull(), F.col("ord"))).alias("m"), F.coalesce(F.bool_or(F.col("method") == "ambiguous"), F.lit(False)).alias("amb"))
    person = F.when(F.size("p") == 1, F.get("p", F.lit(0))).when((F.size("p") > 1) & (F.size("b") == 1), F.get("b", F.lit(0)))
    method = F.when(F.size("p") == 1, F.col("m")).when((F.size("p") > 1) & (F.size("b") == 1), "spelling_conflict+squad").when(F.size("p") > 1, "conflict").when(F.col("amb"), "ambiguous").otherwise("unresolved")
    out = one.select("player_id", person.alias("person_id"), method.alias("method"))
    if overrides is None:
        return out
    o = overrides.select("player_id", F.col("person_id").alias("_o"), "action")
    return out.join(o, "player_id", "left").select("player_id", F.when(F.col("action") == "block", F.lit(None)).when(F.col("action") == "map", F.col("_o")).otherwise(F.col("person_id")).alias("person_id"), F.when(F.col("action") == "block", "blocked").when(F.col("action") == "map", "override").otherwise(F.col("method")).alias("method"))


def collisions(resolved: DataFrame) -> DataFrame:
    """(person_id, n, players): persons that more than one player is taken for."""
    return resolved.where("person_id is not null").groupBy("person_id").agg(F.countDistinct("player_id").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("player_id").cast("string"))), "|").alias("players")).where("n > 1")


def report(resolved: DataFrame) -> DataFrame:
    """(method, n, percent) over a resolution."""
    n = F.count("*")
    return resolved.groupBy("method").agg(n.alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))  # one row a method


def triage(resolved: DataFrame, roster: DataFrame) -> DataFrame:
    """Unresolved players with their spellings, years, teams, appearances and highest price, the costliest first.

    roster: player_id, spelling, year, team, price.  cost is the price times the appearances.
    """
    some = resolved.where("person_id is null").select("player_id", F.col("method").alias("reason"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(f"{c}s")
    facts = roster.groupBy("player_id").agg(joined("spelling"), joined("year"), joined("team"), F.count("*").alias("n"), F.max("price").alias("price"))
    return some.join(facts, "player_id").withColumn("cost", F.coalesce("price", F.lit(0.0)) * F.col("n")).orderBy(F.desc("cost"), "player_id")


def last_salary(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (player_id, season) with the player's last salary of an earlier season, and flags where there is none.

    history: player_id, season, amount; of one season's amounts the highest counts.
    """
    from tidemark.functions.exprs import with_missing
    from tidemark.operators.asof import asof_join

    one = history.where("amount is not null").groupBy("player_id", "season").agg(F.max("amount").alias("amount"))
    return with_missing(asof_join(rows, one, "player_id", "season", {"last_salary": "amount"}), ["last_salary"])
