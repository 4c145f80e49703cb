"""Running sums over keys of any size: range partitions, totals carried from one to the next, sums within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.io import shared_table


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], current: bool = False, parts: int | None = None) -> DataFrame:
    """df with the sum of each expression over its key's rows before (with ``current``, up to) the row; null counts as 0.

    Rows are dealt to ranges of key and order, so a key of a third of all rows is a third of the tasks, and
    equal places stay together.  Each range's totals by key are a small table whose prefix sums are what a range
    begins with.  The ranges are written once, so that a lost task finds its rows where they were.  Rows of
    one place are summed in no fixed order, as in any window.  Keys may be null; without keys all rows are one.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amounts = {f"_x{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    key = F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_0"))
    ranged = df.withColumn("_key", key).repartitionByRange(parts, "_key", *order).withColumns({"_part": F.spark_partition_id(), **amounts})
    rows = shared_table(ranged, "ranges")
    totals = rows.groupBy("_key", "_part").agg(*(F.sum(x).alias(f"_s{x}") for x in amounts))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    carried = totals.select(F.struct("_key", "_part").alias("_own"), *(F.coalesce(F.sum(f"_s{x}").over(earlier), F.lit(0)).alias(f"_b{x}") for x in amounts))
    inside = Window.partitionBy("_own").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    met = rows.withColumn("_own", F.struct("_key", "_part")).join(carried, "_own")  # one shuffle for the join and the window
    made = {name: F.col(f"_b{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for name, x in zip(sums, amounts, strict=True)}
    return met.withColumns(made).select(*(c for c in df.columns if c not in made), *made)
