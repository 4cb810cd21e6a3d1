"""Per-series diagnostics: unit roots, heavy tails, out-of-sample comparison, frequency response."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import autoregression as ar
from . import refit
from .simulate import Var


def adf_statistic(x: np.ndarray, most: int) -> tuple[float, int]:
    """Augmented Dickey-Fuller statistic with a constant, and the number of lagged differences (least AIC)."""
    d, best = np.diff(x), (np.inf, float("nan"), 0)
    n = len(d) - most
    if n < most + 4 or np.ptp(x) == 0:
        return float("nan"), 0
    for p in range(most + 1):
        cols = [np.ones(n), x[most:-1], *[d[most - k : len(d) - k] for k in range(1, p + 1)]]
        z, y = np.stack(cols, 1), d[most:]
        g = np.linalg.pinv(z.T @ z)
        b = g @ z.T @ y
        rss = float(((y - z @ b) ** 2).sum())
        if rss <= 0:
            continue
        aic = n * math.log(rss / n) + 2 * z.shape[1]
        if aic < best[0]:
            best = (aic, float(b[1] / math.sqrt(rss / (n - z.shape[1]) * g[1, 1])), p)
    return best[1], best[2]


def student_t_fit(x: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """Degrees of freedom, location and scale of greatest likelihood: weights by expectation, degrees on a grid."""
    grid = np.concatenate([np.geomspace(1, 50, 40), [200.0]])
    best = (-np.inf, float("nan"), float(np.mean(x)), float(np.std(x)))
    if len(x) < 3 or np.ptp(x) == 0:
        return best[1:]
    for nu in grid:
        m, s2 = float(np.median(x)), float(np.var(x))
        for _ in range(rounds):
            w = (nu + 1) / (nu + (x - m) ** 2 / s2)
            m_new = float((w * x).sum() / w.sum())
            s_new = max(float((w * (x - m_new) ** 2).mean()), 1e-300)
            done = abs(m_new - m) < 1e-9 and abs(s_new - s2) < 1e-9 * s2
            m, s2 = m_new, s_new
            if done:
                break
        like = len(x) * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2)) - (nu + 1) / 2 * float(np.log1p((x - m) ** 2 / (nu * s2)).sum())
        if like > best[0]:
            best = (like, float(nu), m, math.sqrt(s2))
    return best[1:]


def _each(series: DataFrame, f, columns: str, names: list[str]) -> DataFrame:
    kind = dict(series.dtypes)["i"]

    def apply(batches):
        for pdf in batches:
            yield pd.DataFrame([(r.i, *f(np.asarray(r.xs, float))) for r in pdf.itertuples()], columns=["i", *names])

    return series.mapInPandas(apply, f"i {kind}, {columns}")


def stationarity(series: DataFrame, most: int = 4) -> DataFrame:
    return _each(series, lambda x: adf_statistic(x, most), "adf double, lags int", ["adf", "lags"])


def heavy_tails(series: DataFrame) -> DataFrame:
    return _each(series, student_t_fit, "nu double, mu double, sigma double", ["nu", "mu", "sigma"])


def out_of_sample(edges_with_loops: DataFrame, series: DataFrame, p: int, most: int) -> DataFrame:
    """i, and the error variances after the first `most` steps: of the graph's fit, an own autoregression, and none."""
    g = refit.estimate(edges_with_loops, series, p, "lstsqr", most - p).select(F.col("dst").alias("i"), F.col("sv2_hat").alias("graph"))
    return g.join(refit.ar_baseline(series, p, most).select("i", F.col("error").alias("own"), "variance"), "i")


def frequency_response(spark, b: np.ndarray, points: int = 64) -> DataFrame:
    """omega, src, dst and the power that passes from src to dst."""
    w = np.linspace(0, math.pi, points)
    h = Var(b).power_transfer(w)
    n = h.shape[1]
    return spark.createDataFrame(pd.DataFrame({"omega": np.repeat(w, n * n), "dst": np.tile(np.repeat(np.arange(n), n), points), "src": np.tile(np.arange(n), n * points), "power": h.ravel()}))


def learning_curve(results: DataFrame, x: str = "t") -> DataFrame:
    """Mean and deviation of a metric by sample size."""
    return results.groupBy("algo", "metric", x).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.count("*").alias("n"))


def autocorrelation(x: np.ndarray, most: int) -> np.ndarray:
    r = ar.covariances(x[:, None] - x.mean(), most)[:, 0, 0]
    return r / r[0] if r[0] > 0 else r
