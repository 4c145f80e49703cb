"""Evaluation: robust spread, rank correlation, profiles, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import correlation_p
from tidemark.operators.quantiles import quantiles, with_quantiles


def mad(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Median and median absolute deviation about it, for each key."""
    keys = keys or []
    rows = df.select(*keys, F.col(value).alias("_v"))
    centre = quantiles(rows, keys, "_v", (0.5,)).select(*keys, F.col("_q")[0].alias("median"))
    joined = rows.join(centre, keys) if keys else rows.crossJoin(F.broadcast(centre))  # one row
    away = joined.select(*keys, "median", F.abs(F.col("_v") - F.col("median")).alias("_d"))
    return quantiles(away, [*keys, "median"], "_d", (0.5,)).select(*keys, "median", F.col("_q")[0].alias("mad"))


def average_rank(df: DataFrame, value: str, alias: str, parts: int = 64) -> DataFrame:
    """df with the value's rank, ties sharing the mean of theirs; null values have none.

    Ranks come from the distinct values: their counts before each, within parts of the value's
    range, and the parts' counts before them.  Where the parts begin needn't be exact.
    """
    edges = sorted(set(df.approxQuantile(value, [i / parts for i in range(1, parts)], 0.01)))  # as many as parts
    part = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < F.col(value))) if edges else F.lit(0)
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")).withColumn("_part", part)
    sums = counts.groupBy("_part").agg(F.sum("_c").alias("_n"))
    first = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row for each part
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.join(F.broadcast(first), "_part").select(value, (F.col("_first") + inside + (F.col("_c") + 1) / 2).alias(alias))
    return df.join(ranks, value, "left")


def spearman(df: DataFrame, x: str, y: str, alias: str = "rho", p: str | None = None) -> DataFrame:
    """One row: the rank correlation of rows that have both values and, if ``p`` names it, its two-sided p-value."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias(alias), *([F.count("*").alias(p)] if p else []))
    return ranked.withColumn(p, correlation_p(alias, p)) if p else ranked


def profile(df: DataFrame, value: str, keys: list[str], points: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Exact linear quantiles (columns p01, ...) for each key."""
    made = quantiles(df, keys, value, points)
    return made.select(*keys, *(F.col("_q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(points)))


def by_bin(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    made = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return with_quantiles(made, quantiles(df, keys, value, (0.5,)), keys).select(*keys, "n", "mean", "std", F.col("_q")[0].alias("median"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and range of a measure for each configuration."""
    made = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"))
    return with_quantiles(made, quantiles(df, keys, value, (0.5,)), keys).select(*keys, F.col("_q")[0].alias("median"), "spread")


def within_interval(value: Column, lower: Column, upper: Column) -> Column:
    return F.coalesce((value >= lower) & (value <= upper), F.lit(False))
