"""Folding events into statistics of the entities that take part in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """How a row counts for one of its parties: the party's column and what it adds to each quantity."""

    name: str
    entity: Column
    adds: dict[str, Column]
    where: Column | None = None


def fold_roles(df: DataFrame, roles: list[Role], by: dict[str, Column], dates: Column | None = None) -> DataFrame:
    """Sums of all roles' quantities for each (entity, by...): roles are stacked and summed in one shuffle.

    A quantity that a role does not add is 0 for it.  Rows whose entity is null count for none.
    """
    names = list(dict.fromkeys(n for r in roles for n in r.adds))
    stacked = None
    for r in roles:
        rows = df if r.where is None else df.where(r.where)
        one = rows.select(r.entity.alias("entity"), *(c.alias(n) for n, c in by.items()), *(r.adds.get(n, F.lit(0)).alias(n) for n in names), *([] if dates is None else [dates.alias("first_date")]))
        stacked = one if stacked is None else stacked.unionByName(one)
    first = [] if dates is None else [F.min("first_date").alias("first_date")]
    return stacked.where("entity is not null").groupBy("entity", *by).agg(*(F.sum(n).alias(n) for n in names), *first)


def phase_sums(df: DataFrame, keys: list[str], phase: Column, labels: list[str], sums: dict[str, Column]) -> DataFrame:
    """Each sum split by phase: columns <sum>_<label>, 0 where there is nothing."""
    made = [F.coalesce(F.sum(F.when(phase == label, c)), F.lit(0)).alias(f"{name}_{label}") for name, c in sums.items() for label in labels]
    return df.groupBy(*keys).agg(*made)


def empty_groups(df: DataFrame, outer: list[str], inner: list[str], counts: Column, least: Column, alias: str) -> DataFrame:
    """For each outer key its number of inner groups that have the least rows but nothing to count
    (overs without runs, orders without returns)."""
    one = df.groupBy(*outer, *inner).agg(F.sum(counts).alias("_c"), F.sum(least).alias("_l"))
    return one.groupBy(*outer).agg(F.sum(F.when((F.col("_c") == 0) & (F.col("_l") > 0), 1).otherwise(0)).alias(alias))


def sorted_list(df: DataFrame, key: str, value: str, alias: str, sep: str = "|") -> DataFrame:
    """Each key's distinct values in order as one string, and their number."""
    return df.groupBy(key).agg(F.collect_set(value).alias("_s")).select(key, F.array_join(F.array_sort("_s"), sep).alias(alias), F.size("_s").cast("long").alias(f"n_{alias}"))


def longest(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """Each key's longest value, the alphabetically first of equally long ones."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(-F.length(value), F.col(value))).alias(alias))


def group_profile(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows of each group and the share, in percent to one digit, that the flag holds for."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(flag.cast("double")) * 100, 1).alias("percent"))


def first_seen(df: DataFrame, entities: list[str], date: str) -> DataFrame:
    """(entity, first_date) over all columns that name an entity."""
    return df.select(F.explode(F.array(*entities)).alias("entity"), date).where("entity is not null").groupBy("entity").agg(F.min(date).alias("first_date"))
