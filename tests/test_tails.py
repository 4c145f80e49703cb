"""Normal and Student tails as array code, against the standard library, closed forms and tabled values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import asof, metrics


def test_normal_tails_against_the_error_function():
    x = np.concatenate([np.linspace(-37, 8, 4001), [-0.0, 0.0, 1e-300, -1e-300]])
    want = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v < 0 else math.log1p(-0.5 * math.erfc(v / math.sqrt(2))) for v in x])
    assert np.allclose(normal.log_cdf(x), want, rtol=3e-13, atol=1e-300)


def test_normal_tails_far_out():
    assert normal.log_cdf(np.array([-np.inf, np.inf])).tolist() == [-math.inf, 0.0]
    assert np.isnan(normal.log_cdf(np.array([np.nan]))).all()
    for x in (40.0, 1e3, 1e6):  # the asymptotic series
        w = 1 / (x * x)
        want = -x * x / 2 - math.log(x * math.sqrt(2 * math.pi)) + math.log1p(-w + 3 * w**2 - 15 * w**3 + 105 * w**4)
        assert normal.log_cdf(np.array([-x]))[0] == pytest.approx(want, rel=1e-13)


def test_between_keeps_digits():
    got = normal.log_between(np.array([-1.0, 30.0, -math.inf, -40.0]), np.array([1.0, math.inf, 0.0, -39.0]))
    want = [math.log(math.erf(1 / math.sqrt(2))), math.log(0.5 * math.erfc(30 / math.sqrt(2))), math.log(0.5)]
    assert got[:3] == pytest.approx(want, rel=1e-13)
    assert got[3] == pytest.approx(float(normal.log_cdf(np.array([-39.0]))[0]), rel=1e-12)


def test_columns_pass_nulls(spark):
    df = spark.createDataFrame([(0.0,), (None,), (-1.0,)], "z double")
    got = df.select(normal.normal_cdf("z").alias("c"), normal.log_normal_cdf("z").alias("l")).collect()
    assert [r["c"] for r in got] == [0.5, None, pytest.approx(0.15865525393145707, rel=1e-14)]
    assert [r["l"] for r in got] == [pytest.approx(math.log(0.5)), None, pytest.approx(math.log(0.15865525393145707))]


@pytest.mark.parametrize(("t", "df", "p"), [
    (12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.2281388519649385, 10, 0.05), (3.169272667175838, 10, 0.01), (2.0422724563012373, 30, 0.05), (1.9839715185235518, 100, 0.05), (0.0, 5, 1.0), (math.inf, 5, 0.0),
])
def test_student_tails_as_tabled(t, df, p):
    assert float(normal.student_tails(t, df)) == pytest.approx(p, abs=1e-9)
    assert float(normal.student_tails(-t, df)) == pytest.approx(p, abs=1e-9)


def test_student_tails_in_closed_form_and_in_the_limit():
    t = np.array([1e-6, 0.1, 0.5, 1.0, 3.0, 50.0, 1e4])
    assert np.allclose(normal.student_tails(t, 1), 1 - 2 * np.arctan(t) / math.pi, rtol=1e-9, atol=1e-13)
    assert np.allclose(normal.student_tails(t, 2), 2 / (np.sqrt(t * t + 2) * (np.sqrt(t * t + 2) + t)), rtol=1e-9, atol=1e-13)
    assert float(normal.student_tails(1.959963984540054, 1e8)) == pytest.approx(0.05, abs=1e-8)
    assert np.isnan(normal.student_tails(1.0, 0.0))


def test_spearman_with_its_p(spark):
    pairs = [(1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5), (7, 8), (8, 7), (9, None)]
    row = metrics.spearman(spark.createDataFrame(pairs, "x int, y int"), "x", "y", p="p").first()
    rho = 1 - 6 * 8 / (8 * 63)
    assert row["rho"] == pytest.approx(rho)
    t = rho * math.sqrt(6 / (1 - rho * rho))
    u = t / math.sqrt(6 + t * t)  # six degrees in closed form
    assert row["p"] == pytest.approx(1 - u * (1 + (1 - u * u) / 2 + 3 * (1 - u * u) ** 2 / 8), abs=1e-12)
    two = metrics.spearman(spark.createDataFrame(pairs[:2], "x int, y int"), "x", "y", p="p").first()
    assert (two["rho"], two["p"]) == (-1.0, None)


def test_recent_totals_keep_digits_and_nulls(spark):
    days = spark.createDataFrame([("a", f"2020-01-{d:02d}", d, v) for d, v in [(1, 1e17), (2, None), (3, 0.25), (4, 0.5)]], "k string, day string, m int, v double").withColumn("day", F.to_date("day"))
    asked = spark.createDataFrame([("a", "2020-01-03"), ("a", "2020-02-01"), ("b", "2020-02-01")], "k string, at string").withColumn("at", F.to_date("at"))
    got = {(r["k"], str(r["at"])): (r["matches"], r["v"]) for r in asof.recent_of(days, asked, "k", "day", "m", "at", 2, {"v": F.col("v")}).collect()}
    assert got == {("a", "2020-01-03"): (2, 1e17), ("a", "2020-02-01"): (2, 0.75), ("b", "2020-02-01"): (0, 0.0)}
