"""Scoring a trained model and judging what it predicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions.exprs import log_ratio
from tidemark.operators import encode, metrics


def score(df: DataFrame, features: list[str], layers: list[tuple[np.ndarray, np.ndarray]], key: str, floor: float = 0.05, ceiling: float = 1.5) -> DataFrame:
    """(key, mu, sigma): a small network with two outputs, its second held between floor and ceiling.

    layers are (weights, bias) pairs with rectifiers between; they travel with the tasks.
    """

    def run(frames):
        for frame in frames:
            x = frame[features].to_numpy(float)
            for i, (w, b) in enumerate(layers):
                x = x @ w + b
                if i < len(layers) - 1:
                    x = np.maximum(x, 0)
            yield pd.DataFrame({key: frame[key], "mu": x[:, 0], "sigma": floor + (ceiling - floor) / (1 + np.exp(-x[:, 1]))})

    return df.select(key, *features).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, mu double, sigma double")


def predictions(df: DataFrame, actual: str = "price", lower: str = "lower", upper: str = "upper", band: float = 0.2) -> DataFrame:
    """df (mu, sigma) with the lognormal's median, mean and range, the log ratio to the actual value,
    and whether the median lies within the interval and within a band of the actual value."""
    made = df.withColumns(normal.lognormal_summary(F.col("mu"), F.col("sigma")))
    ratio = log_ratio(F.col("median"), F.col(actual))
    return made.withColumns({"log_ratio": F.when(F.col(actual).isNotNull(), ratio), "within_interval": metrics.within_interval(F.col("median"), F.col(lower), F.col(upper)), "within_band": F.coalesce(F.abs(F.col("median") - F.col(actual)) <= band * F.col(actual), F.lit(False))})


def summary(df: DataFrame, actual: str = "price") -> DataFrame:
    """One row: rows, MAD and median of the log ratio, rank correlation, shares within interval and band."""
    known = df.where(F.col(actual).isNotNull())
    spread = metrics.mad(known, "log_ratio").select(F.col("median").alias("bias"), "mad")
    rho = metrics.spearman(known, "median", actual)
    shares = known.agg(F.count("*").alias("n"), F.avg(F.col("within_interval").cast("double")).alias("within_interval"), F.avg(F.col("within_band").cast("double")).alias("within_band"))
    return shares.crossJoin(spread).crossJoin(rho)  # one row each


def trend(df: DataFrame, by: str, value: str, bins: int = 6) -> DataFrame:
    return metrics.by_bin(encode.quantile_bins(df, by, bins), ["bin"], value)


def training_rows(df: DataFrame, lower: str = "lower", upper: str = "upper", label: str = "label", by: str = "price", bins: int = 6) -> DataFrame:
    """Rows fit for training: no unknown label, a sound interval, and a weight that makes labels and price bins count alike."""
    sound = df.where((F.col(label) != "unknown") & (F.col(lower) > 0) & (F.col(upper) > F.col(lower)))
    binned = encode.quantile_bins(sound, by, bins, [label])
    return encode.strata_weights(binned, F.concat_ws("/", F.col(label), F.col("bin").cast("string")))
