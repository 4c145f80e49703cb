"""Encodings fitted on one table and applied to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clipped_z
from tidemark.operators.quantiles import quantiles
from tidemark.operators.scan import running_sums


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values in order from 0, however many there are."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return running_sums(values, [], [F.col("value")], {"code": F.lit(1)})


def label_encode(df: DataFrame, column: str, codes: DataFrame, alias: str) -> DataFrame:
    """df with the value's code; a value the vocabulary hasn't is an error."""
    known = df.join(codes.select(F.col("value").alias(column), F.col("code").alias("_code")), column, "left")
    check = F.when(F.col("_code").isNull() & F.col(column).isNotNull(), F.raise_error(F.concat(F.lit(f"{column} is unknown: "), F.col(column).cast("string")))).otherwise(F.col("_code"))
    return known.withColumn(alias, check.cast("long")).drop("_code")


def one_hot(df: DataFrame, column: str, most: int = 24) -> DataFrame:
    """df with <column>=<value> flags; a column of more than ``most`` values is left as it is."""
    values = [x[0] for x in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        return df
    return df.withColumns({f"{column}={v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def scaler_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, log, mean, std): exact quantiles of all features at once, then one pass for the moments.

    A feature is taken as log1p if it isn't negative, its 99th percentile is over 50 and over
    three times its median and one.  A deviation under 1e-6 counts as 1.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    found = quantiles(long, ["feature"], "x", (0.0, 0.5, 0.99))
    q = lambda i: F.col("_q")[i]
    one = found.select("feature", F.coalesce((q(0) >= 0) & (q(2) > 50) & (q(2) > 3 * (q(1) + 1)), F.lit(False)).alias("log"))  # one row a feature
    value = F.when(F.col("log"), F.log1p(F.greatest("x", F.lit(0.0)))).otherwise(F.col("x"))
    moments = long.join(F.broadcast(one), "feature").groupBy("feature", "log").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return moments.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def scale(df: DataFrame, params: DataFrame) -> DataFrame:
    """df with each fitted feature scaled and held to +-10; a null becomes 0 and flags <feature>_is_missing."""
    rows = params.collect()  # one row a feature
    made = {r["feature"]: F.coalesce(clipped_z(F.col(r["feature"]).cast("double"), r["mean"], r["std"], r["log"]), F.lit(0.0)) for r in rows}
    return df.withColumns({f"{r['feature']}_is_missing": F.col(r["feature"]).isNull().cast("double") for r in rows}).withColumns(made)


def quantile_bins(df: DataFrame, value: str, bins: int, keys: list[str] | None = None, alias: str = "bin") -> DataFrame:
    """df with the number of the value's quantile bin from 0, within each key.

    Edges are linear quantiles without repeats, bins closed on the right, the first on both sides.
    """
    keys = keys or []
    edges = quantiles(df, keys, value, tuple(i / bins for i in range(bins + 1))).withColumn("_e", F.array_distinct("_q")).drop("_q")
    joined = df.join(edges, keys, "left") if keys else df.crossJoin(F.broadcast(edges))
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    return joined.withColumn(alias, F.size(F.filter(inner, lambda e: e < F.col(value))).cast("long")).drop("_e")


def strata_weights(df: DataFrame, stratum: str | Column, alias: str = "weight") -> DataFrame:
    """df with N / (K * n): every one of K strata weighs the same in all."""
    s = F.col(stratum) if isinstance(stratum, str) else stratum
    counts = df.groupBy(s.alias("_s")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select("_s", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(alias))
    return df.withColumn("_s", s).join(F.broadcast(weights), "_s").drop("_s")
