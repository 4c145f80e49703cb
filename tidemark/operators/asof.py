"""Statistics and joins as of a moment: everything strictly before it, never at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_number(column: str) -> Column:
    return F.datediff(F.to_date(column), F.lit("1970-01-01"))


def career_before(df: DataFrame, key: str, time: str, aggs: dict[str, Column]) -> DataFrame:
    """df with each aggregate over the key's rows of earlier days.

    A day's rows leave each other out: the frame is a range of day numbers, not of rows.
    """
    day = day_number(time)
    before = Window.partitionBy(key).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_day", day).withColumns({name: agg.over(before) for name, agg in aggs.items()}).drop("_day")


def trailing_periods(df: DataFrame, key: str, period: Column, n: int, aggs: dict[str, Column]) -> DataFrame:
    """df with each aggregate over the key's last n distinct periods before the row's own."""
    ranked = df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(key).orderBy(period)))
    last = Window.partitionBy(key).orderBy("_rank").rangeBetween(-n, -1)
    return ranked.withColumns({name: agg.over(last) for name, agg in aggs.items()}).drop("_rank")


def totals_at(df: DataFrame, keys: DataFrame, key: str, time: str, sums: dict[str, Column], until: Column, since: Column | None = None) -> DataFrame:
    """For each of the keys its totals over [since, until); keys without rows have zeros."""
    day = F.to_date(time)
    rows = df.where(day < until) if since is None else df.where((day >= since) & (day < until))
    totals = rows.groupBy(key).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    return keys.select(key).distinct().join(totals, key, "left").select(key, *(F.coalesce(name, F.lit(0)).alias(name) for name in sums))


def totals_of(df: DataFrame, requests: DataFrame, key: str, time: str, at: str, sums: dict[str, Column]) -> DataFrame:
    """For requests (key, at) the totals of the key's rows on days before ``at``; requests without rows have zeros.

    Rows and requests go through one window by key and day, which no range join is needed for.
    """
    day, asked = F.to_date(time), F.to_date(at)
    rows = df.select(key, day.alias("_day"), F.lit(None).cast(requests.schema[at].dataType).alias(at), *(c.alias(name) for name, c in sums.items()), F.lit(False).alias("_ask"))
    ask = requests.select(key, asked.alias("_day"), at, *(F.lit(None).cast("double").alias(name) for name in sums), F.lit(True).alias("_ask"))
    before = Window.partitionBy(key).orderBy(F.datediff("_day", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(ask).withColumns({name: F.coalesce(F.sum(name).over(before), F.lit(0)) for name in sums})
    return both.where("_ask").select(key, at, *sums)


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: dict[str, str], order: list[Column] | None = None) -> DataFrame:
    """left with the values (new name: right's column) of the key's last right row strictly before.

    Of right rows at one key and time the last by ``order`` counts.  Both sides go through one
    window, left before right at equal times.
    """
    last = Window.partitionBy(key, time).orderBy(*(c.desc() for c in (order or [F.lit(0)])))
    one = right.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    held = F.struct(*(F.col(c).alias(name) for name, c in values.items()))
    kind = one.select(held.alias("h")).schema["h"].dataType
    both = left.withColumn("_side", F.lit(0)).withColumn("_held", F.lit(None).cast(kind)).unionByName(one.select(key, time, F.lit(1).alias("_side"), held.alias("_held")), allowMissingColumns=True)
    past = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_held", F.last("_held", ignorenulls=True).over(past)).where("_side = 0")
    return found.select(*left.columns, *(F.col(f"_held.{name}").alias(name) for name in values))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def new_period(df: DataFrame, key: str, period: Column, order: list[Column]) -> DataFrame:
    """df with is_new (the key's first row in its period) and periods (distinct ones so far, this included)."""
    first = F.row_number().over(Window.partitionBy(key, period).orderBy(*order)) == 1
    so_far = F.dense_rank().over(Window.partitionBy(key).orderBy(period))
    return df.withColumn("is_new", first).withColumn("periods", so_far.cast("long"))


def running_before(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with each sum over the key's rows before this one; 0 for the first."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})


def recent_of(df: DataFrame, requests: DataFrame, key: str, day: str, match: str, at: str, n: int, sums: dict[str, Column]) -> DataFrame:
    """For requests (key, at) the totals over the key's last n matches before ``at``, and how many they are.

    Rows are summed by match first.  Matches are numbered by day and match, so two of one day are
    two.  Of matches and requests in one order a request sees the last n matches of earlier days:
    sums over a frame of n matches, with no range join and no digits lost; null values count as 0.
    """
    played = df.groupBy(key, F.col(day).alias("_day"), F.col(match).alias("_match")).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    order = Window.partitionBy(key).orderBy("_day", "_match")
    last = order.rowsBetween(1 - n, 0)
    state = played.select(key, "_day", "_match", F.least(F.row_number().over(order), F.lit(n)).cast("long").alias("matches"), *(F.coalesce(F.sum(name).over(last), F.lit(0)).alias(name) for name in sums))
    held = ["matches", *sums]
    rows = state.select(key, F.col("_day").alias("_t"), F.lit(1).alias("_side"), F.col("_match").cast("string").alias("_last"), F.struct("_match").alias("_o"), F.lit(None).cast(requests.schema[at].dataType).alias(at), F.struct(*held).alias("_held"))
    ask = requests.select(key, F.to_date(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_last"), F.lit(None).cast(rows.schema["_o"].dataType).alias("_o"), at, F.lit(None).cast(rows.schema["_held"].dataType).alias("_held"))
    past = Window.partitionBy(key).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.unionByName(ask).withColumn("_held", F.last("_held", ignorenulls=True).over(past)).where("_side = 0")
    return found.select(key, at, *(F.coalesce(F.col(f"_held.{c}"), F.lit(0)).alias(c) for c in held))
