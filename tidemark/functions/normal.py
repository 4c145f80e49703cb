"""Normal tails and the likelihood of interval-censored log values; SQL has no error function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _scaled_tail(z: float) -> float:
    """exp(z^2) erfc(z) for z >= 0, by its continued fraction where the product would lose digits."""
    if z < 2:
        return math.exp(z * z) * math.erfc(z)
    rest = z
    for k in range(400, 0, -1):
        rest = z + k / 2 / rest
    return 1 / (rest * math.sqrt(math.pi))


def _tail_series(n: int = 40) -> np.ndarray:
    """Chebyshev coefficients of log(exp(z^2) erfc(z) / t) over t = 2 / (2 + z) in (0, 1], which is smooth up to z without end."""
    return np.polynomial.chebyshev.chebinterpolate(np.vectorize(lambda u: math.log(_scaled_tail(4 / (u + 1) - 2) / ((u + 1) / 2))), n)


_TAIL = _tail_series()


def log_tail(x: np.ndarray) -> np.ndarray:
    """Logarithm of the normal probability beyond |x|, for arrays."""
    z = np.abs(x) / math.sqrt(2)
    t = 2 / (2 + z)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isinf(z), -np.inf, np.polynomial.chebyshev.chebval(2 * t - 1, _TAIL) + np.log(t) - z * z - math.log(2))


def log_cdf(x: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, for arrays; digits hold in both tails."""
    x = np.asarray(x, dtype="float64")
    tail = log_tail(x)
    return np.where(x < 0, tail, np.log1p(-np.exp(tail)))


def log_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the probability between a and b, on the side of 0 where no digits are lost, for arrays."""
    a, b = np.where(a > 0, -b, a), np.where(a > 0, -a, b)
    high, low = log_cdf(b), log_cdf(a)
    with np.errstate(invalid="ignore"):
        return high + np.log1p(-np.exp(np.minimum(low - high, -1e-15)))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    x = z.to_numpy(dtype="float64", na_value=np.nan)
    tail = np.exp(log_tail(x))
    return pd.Series(np.where(x < 0, tail, 1 - tail)).where(z.notna().to_numpy())


@F.pandas_udf(DoubleType())
def log_normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(log_cdf(z.to_numpy(dtype="float64", na_value=np.nan))).where(z.notna().to_numpy())


@F.pandas_udf(DoubleType())
def interval_nll(lower: pd.Series, upper: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
    """-log P(lower < X <= upper) of a log-normal X; sigma is held to [0.05, 3], upper to lower + 0.001 at least."""
    s = sigma.clip(0.05, 3.0)
    top = np.maximum(upper, lower + 1e-3)
    a, b = (np.log(lower.clip(lower=1e-12)) - mu) / s, (np.log(top.clip(lower=1e-12)) - mu) / s
    return pd.Series(-log_between(a.to_numpy(dtype="float64"), b.to_numpy(dtype="float64"))).where((a.notna() & b.notna()).to_numpy())


def _gamma_ratio(a: np.ndarray) -> np.ndarray:
    """log(gamma(a + 1/2) / gamma(a)) for arrays: fifty steps up, then the asymptotic series."""
    k = np.arange(50).reshape(-1, *([1] * np.ndim(a)))
    up = a + 50
    return np.log((a + k) / (a + k + 0.5)).sum(axis=0) + 0.5 * np.log(up) - 1 / (8 * up) + 1 / (192 * up**3) - 1 / (640 * up**5)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int = 100_000) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz), for arrays."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, most):
        step = np.ones_like(x)
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + e * d), safe(1 + e / c)
            h, step = h * d * c, d * c
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def student_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The probability that Student's t of df degrees is beyond |t| on either side, for arrays; df under 1 has none."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype="float64"), np.asarray(df, dtype="float64"))
    told = (df >= 1) & ~np.isnan(t)
    n, v = np.where(told, df, 1.0), np.where(told & np.isfinite(t), t * t, 1.0)
    x, y, a, b = n / (n + v), v / (n + v), n / 2, np.full(n.shape, 0.5)
    front = np.exp(_gamma_ratio(a) - math.lgamma(0.5) - a * np.log1p(v / n) + 0.5 * np.log(np.where(y > 0, y, 1.0)))
    near = x >= (a + 1) / (a + 2.5)
    s = np.where(near, 1 - front * _fraction(b, a, np.where(near, y, 0.0)) / b, front * _fraction(a, b, np.where(near, 0.0, x)) / a)
    return np.where(told, np.where(np.isinf(t), 0.0, np.where(v == 0, 1.0, s)), np.nan)


@F.pandas_udf(DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """The two-sided p-value of a rank correlation over n pairs; null under three pairs or without a correlation."""
    r, df = rho.to_numpy(dtype="float64", na_value=np.nan), n.to_numpy(dtype="float64", na_value=np.nan) - 2
    with np.errstate(divide="ignore", invalid="ignore"):
        p = student_tails(np.where(np.abs(r) >= 1, np.inf, r * np.sqrt(df / ((1 + r) * (1 - r)))), df)
    return pd.Series(p).where(~np.isnan(p) & ~np.isnan(r))


def weighted_nll(df: DataFrame, lower: str, upper: str, mu: str, sigma: str, weight: str) -> DataFrame:
    """The weighted mean of interval_nll, one row."""
    scored = df.select(F.col(weight).alias("w"), interval_nll(*(F.col(c).cast("double") for c in (lower, upper, mu, sigma))).alias("l"))
    return scored.agg((F.sum(F.col("l") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-10))).alias("nll"))


def lognormal_summary(mu: Column, sigma: Column, most: float = 700.0) -> dict[str, Column]:
    """Median, mean and the points three sigmas off, with exponents held below ``most``."""
    e = lambda x: F.exp(F.least(x, F.lit(most)))
    return {"median": e(mu), "mean": e(mu + sigma * sigma / 2), "low": e(mu - 3 * sigma), "high": e(mu + 3 * sigma)}
