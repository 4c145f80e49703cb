"""Checks as tables of findings, and assertions that fail a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    return df


def findings(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(check, severity, value) for named conditions: how many rows each holds for, in one pass."""
    counted = df.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"c{i}") for i, (_, c) in enumerate(checks.values())))
    rows = (F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("value")) for i, (n, (s, _)) in enumerate(checks.items()))
    return counted.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come up more than once, with their counts; null keys are no duplicates."""
    some = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return some.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, of which a row fails the query if it repeats a key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key is repeated: "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys))))).otherwise(F.lit(True))).drop("_n")


def join_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that can't add rows: a repeated right key fails the query."""
    return left.join(unique_key(right, keys), keys, "left")


def join_known(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A left join that must find every row: one without a value fails the query."""
    joined = left.join(right, keys, "left")
    told = F.concat(F.lit("nothing is known of: "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))
    return joined.where(F.when(F.col(value).isNull(), F.raise_error(told)).otherwise(F.lit(True)))


def falling(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """For each key whether its values ever fall, in order, and how often."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_p", prev).groupBy(key).agg(F.coalesce(F.bool_or(F.col(value) < F.col("_p")), F.lit(False)).alias("falls"), F.coalesce(F.sum(F.when(F.col(value) < F.col("_p"), 1).otherwise(0)), F.lit(0)).alias("n_falls"))


def bad_intervals(df: DataFrame, lower: str, upper: str) -> DataFrame:
    """Rows whose interval isn't 0 < lower < upper, both finite."""
    ok = F.col(lower).isNotNull() & F.col(upper).isNotNull() & (F.col(lower) > 0) & (F.col(upper) > F.col(lower)) & (F.col(upper) < float("inf"))
    return df.where(~F.coalesce(ok, F.lit(False)))


def reconcile(totals: DataFrame, parts: DataFrame, key: str, total: str, part: Column, within: float) -> DataFrame:
    """(key, total, parts, differs): totals against the sums of their parts; no parts sum to 0."""
    summed = parts.groupBy(key).agg(F.sum(part).alias("parts"))
    joined = totals.join(summed, key, "left").withColumn("parts", F.coalesce("parts", F.lit(0.0)))
    return joined.select(key, F.col(total).alias("total"), "parts", (F.abs(F.col(total) - F.col("parts")) >= within).alias("differs"))


def regressions(df: DataFrame, key: str, edition: str, values: list[str]) -> DataFrame:
    """(key, edition, measure, before, now) where a running total is lower than in the edition just before (adjacent ones only)."""
    editions = df.select(edition).distinct().withColumn("_prev", F.lag(edition).over(Window.orderBy(edition)))  # one row an edition
    now = df.join(F.broadcast(editions), edition)
    past = df.select(key, F.col(edition).alias("_prev"), *(F.col(v).alias(f"_{v}") for v in values))
    long = now.join(past, [key, "_prev"]).select(key, edition, F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(f"_{v}").cast("double").alias("before"), F.col(v).cast("double").alias("now")) for v in values))).alias("m"))
    return long.select(key, edition, "m.*").where("now < before")


def concat_strict(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, in any order; other columns are an error."""
    first = set(tables[0].columns)
    for df in tables[1:]:
        if odd := first ^ set(df.columns):
            raise ValueError(f"columns are not in all tables: {', '.join(sorted(odd))}")
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def restricted(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of the given values; none at all is an error, told before anything is built on them."""
    kept = df.where(F.col(column).isin(*values))
    if kept.isEmpty():
        raise ValueError(f"no row has {column} of {values}")
    return kept


def sound_intervals(df: DataFrame, lower: str, upper: str, shown: int = 10) -> DataFrame:
    """df, if all its intervals are 0 < lower < upper; else an error that shows some that aren't."""
    bad = bad_intervals(df, lower, upper).select(lower, upper).limit(shown).collect()
    if bad:
        raise ValueError("intervals are not sound: " + ", ".join(f"({r[0]}, {r[1]})" for r in bad))
    return df


def _told(check: str, severity: str, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("value").cast("long").alias("value"))


def unmatched(check: str, severity: str, df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """A finding: how many rows have a key that the other table lacks."""
    return _told(check, severity, df.select(key).join(other.select(other_key), F.col(key) == F.col(other_key), "left_anti").agg(F.count("*").alias("value")))


def repeated(check: str, severity: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """A finding: how many keys come up more than once."""
    return _told(check, severity, duplicate_keys(df, keys).agg(F.count("*").alias("value")))


def audit(found: list[DataFrame]) -> DataFrame:
    """Findings of several tables as one."""
    return concat_strict(found)
