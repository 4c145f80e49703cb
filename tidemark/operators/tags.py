"""Multi-label tags: supply, demand, scarcity, and a row's view of its own tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import any_true


def exploded(df: DataFrame, key: str, tags: Column) -> DataFrame:
    """(key, tag) for each tag of each row; a row counts for all its tags."""
    return df.select(key, F.explode(F.array_distinct(tags)).alias("tag"))


def supply(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("tag").agg(F.count("*").alias("supply"))


def demand(bought: DataFrame, buyers: DataFrame, buyer: str, targets: DataFrame, able: Column | None = None) -> DataFrame:
    """(tag, demand): able buyers that hold fewer of a tag than its target (bought: buyer, tag, n)."""
    who = buyers.where(able) if able is not None else buyers
    every = who.select(buyer).distinct().crossJoin(F.broadcast(targets))
    return every.join(bought, [buyer, "tag"], "left").groupBy("tag").agg(F.sum(F.when(F.coalesce("n", F.lit(0)) < F.col("target"), 1).otherwise(0)).alias("demand"))


def scarcity(demanded: DataFrame, supplied: DataFrame) -> DataFrame:
    """(tag, demand, supply, scarcity): demand over supply, of which 1 counts at least."""
    both = demanded.join(supplied, "tag", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    return both.withColumn("scarcity", F.col("demand") / F.greatest(F.col("supply"), F.lit(1)))


def focus(tagged: DataFrame, key: str, scores: DataFrame, value: str) -> DataFrame:
    """For each key the least, greatest and mean value over its own tags."""
    return tagged.join(scores, "tag").groupBy(key).agg(F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"), F.avg(value).alias(f"{value}_mean"))


def sharing(tagged: DataFrame, key: str) -> DataFrame:
    """(key, n) rows that share a tag with a row, itself included; tag sets are counted once each, so
    the pairs are of sets, not of rows."""
    sets = tagged.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    kinds = sets.groupBy("tags").agg(F.count("*").alias("n"))
    other = kinds.select(F.col("tags").alias("other"), "n", F.explode("tags").alias("tag"))
    near = kinds.select("tags", F.explode("tags").alias("tag")).join(other, "tag").select("tags", "other", "n").distinct()
    return sets.join(near.groupBy("tags").agg(F.sum("n").alias("n_sharing")), "tags").select(key, "n_sharing")


def tag_table(df: DataFrame, key: str, direct: list[str], derived: dict[str, Column]) -> DataFrame:
    """(key, tag) from boolean columns and conditions; rows with none are tagged "untagged"."""
    names = {**{c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in direct}, **derived}
    tags = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in names.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("untagged")))).alias("tag"))


def exactly_one(df: DataFrame, when: str, columns: list[str]) -> DataFrame:
    """Rows for which ``when`` holds and not exactly one of the columns does: offenders of an either-or rule."""
    n = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns), F.lit(0))
    return df.where(any_true([when]) & (n != 1))
