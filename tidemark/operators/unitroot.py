"""Unit-root statistics of short series: ADF with lags chosen by AIC or none, KPSS with automatic bandwidth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Asymptotic critical values with a constant at 1, 5 and 10 percent.
ADF_CRITICAL, KPSS_CRITICAL = (-3.43, -2.86, -2.57), (0.739, 0.463, 0.347)

#: The published response surface of the ADF statistic with a constant (its range, where the two polynomials meet, their coefficients by rising power).
ADF_RANGE, ADF_MEET, ADF_LOW, ADF_HIGH = (-18.83, 2.74), -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
#: Published points of the KPSS statistic around a level, and their probabilities.
KPSS_POINTS, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def adf_p(t: float) -> float:
    """p of an ADF statistic: a normal probability of a polynomial in it; 0 and 1 outside the surface's range."""
    if not ADF_RANGE[0] < t < ADF_RANGE[1]:
        return float(t >= ADF_RANGE[1])
    z = sum(c * t**k for k, c in enumerate(ADF_LOW if t <= ADF_MEET else ADF_HIGH))
    return math.erfc(-z / math.sqrt(2)) / 2


def kpss_p(t: float) -> float:
    """p of a KPSS statistic between its published points, their ends beyond them."""
    return float(np.interp(t, KPSS_POINTS, KPSS_P))


def adf(y: np.ndarray, max_lag: int | None = None) -> tuple[float, int]:
    """The t statistic of the level in the differenced regression with a constant, and its number of lags (least AIC up to ``max_lag`` on a common sample)."""
    n = len(y)
    top = int(12 * (n / 100) ** 0.25) if max_lag is None else max_lag
    dy = np.diff(y)

    def fit(p: int, skip: int):
        t = np.arange(skip, len(dy))
        x = np.column_stack([y[t], np.ones(len(t)), *(dy[t - k] for k in range(1, p + 1))])
        b, *_ = np.linalg.lstsq(x, dy[t], rcond=None)
        e = dy[t] - x @ b
        s2 = (e @ e) / max(1, len(t) - x.shape[1])
        aic = len(t) * np.log((e @ e) / len(t)) + 2 * x.shape[1]
        return b[0] / np.sqrt(s2 * np.linalg.pinv(x.T @ x)[0, 0]), aic

    best = min(range(top + 1), key=lambda p: fit(p, top)[1])
    return float(fit(best, best)[0]), best


def kpss(y: np.ndarray) -> tuple[float, int]:
    """Level stationarity with the data-dependent bandwidth of Hobijn, Franses and Ooms."""
    n, e = len(y), y - y.mean()
    cov = int(n ** (2 / 9))
    s0 = e @ e / n
    s1 = 0.0
    for i in range(1, cov + 1):
        r = 2 * (e[i:] @ e[:-i]) / n
        s0, s1 = s0 + r, s1 + i * r
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = e @ e / n + sum(2 * (1 - i / (lags + 1)) * (e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * var)), lags


def unit_roots(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """series, test, statistic, lags, p, rejected at 5 percent (by the critical values); each group is one short series."""

    def run(k, pdf):
        y = pdf.sort_values(order)[value].to_numpy(float)
        rows = [("adf aic", *adf(y)), ("adf lag 0", *adf(y, 0)), ("kpss", *kpss(y))]
        return pd.DataFrame([(k[0], t, s, n, kpss_p(s) if t == "kpss" else adf_p(s), bool(s < ADF_CRITICAL[1] if t != "kpss" else s > KPSS_CRITICAL[1])) for t, s, n in rows], columns=[key, "test", "statistic", "lags", "p", "rejected"])

    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"`{key}` {series.schema[key].dataType.simpleString()}, test string, statistic double, lags int, p double, rejected boolean")


def stationarity(tests: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """One verdict per series: stationary where both ADF tests reject, stationary at lag 0 only (short samples choose too many lags), or not rejected."""
    p = lambda t: F.max(F.when(F.col("test") == t, F.col("p")))
    g = tests.groupBy(key).agg(p("adf aic").alias("p_aic"), F.max(F.when(F.col("test") == "adf aic", F.col("lags"))).alias("lags"), p("adf lag 0").alias("p_lag_0"), p("kpss").alias("p_kpss"))
    verdict = F.when((F.col("p_aic") < alpha) & (F.col("p_lag_0") < alpha), "stationary").when(F.col("p_lag_0") < alpha, "stationary at lag 0 only").otherwise("not rejected")
    return g.withColumn("verdict", verdict)
