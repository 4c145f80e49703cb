"""Exact quantiles of columns of any size: counts by value, prefix sums by parts, and the ranks asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.io import shared_table


def _interpolated(n: Column, p: float, low: Column, high: Column) -> Column:
    at = (n - 1) * F.lit(float(p))
    return F.when((F.ceil(at) == F.floor(at)) | low.eqNullSafe(high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def quantiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...], alias: str = "_q", parts: int = 64) -> DataFrame:
    """(keys, alias): the linear quantiles of each key's values as an array, as exact as ``percentile`` is.

    Rows become counts by key and value where they lie; the counts of a key are summed up in parts of the
    values' range, and each point's two neighbours are picked by their ranks.  Parts are cut at approximate quantiles
    of the whole column, so one part holds a small share of all rows, whatever the keys' sizes are, unless
    it is one value, which is one count.  No task holds a key's values.  Where parts begin needn't be
    exact.  Nulls count for nothing, NaN is above all; a key of nulls has an array of nulls.  Keys may be null.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    edges = sorted(set(rows.approxQuantile("_v", [i / parts for i in range(1, parts)], 0.01)))  # as many as parts
    part = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < F.col("_v"))) if edges else F.lit(0)
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    whole = F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_0"))
    counts = shared_table(counts.withColumns({"_c": F.when(F.col("_v").isNull(), 0).otherwise(F.col("_c")), "_part": F.coalesce(part, F.lit(0))}), "counts")
    own = F.struct(whole.alias("key"), F.col("_part").alias("part"))  # structs of nulls are equal
    sums = counts.groupBy(own.alias("_own")).agg(F.sum("_c").alias("_n"))
    key = Window.partitionBy("_own.key")  # a row for each part
    first = sums.select("_own", F.coalesce(F.sum("_n").over(key.orderBy("_own.part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_n").over(key).alias("_all"))
    inside = Window.partitionBy("_own").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_own", own).join(first, "_own").withColumn("_before", F.col("_first") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    holds = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col("_v")))
    at = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    picked = placed.groupBy(*keys).agg(F.max("_all").alias("_all"), *(x for i, p in enumerate(points) for x in (holds(F.floor(at(p))).alias(f"l{i}"), holds(F.ceil(at(p))).alias(f"h{i}"))))
    return picked.select(*keys, F.array(*(_interpolated(F.col("_all"), p, F.col(f"l{i}"), F.col(f"h{i}")) for i, p in enumerate(points))).alias(alias))


def with_quantiles(grouped: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A table of keys joined with their quantiles; null keys meet."""
    one = lambda df: df.withColumn("_own", F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_0")))
    return one(grouped).join(one(found).drop(*keys), "_own").drop("_own")
