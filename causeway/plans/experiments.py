"""Monte Carlo studies: each drawn system is a row, and a task of its own."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, simulate
from ..sources.tables import materialize
from . import pipeline


def grid(spark: SparkSession, n=(50,), t=(50, 250, 1250), q=(None, 0.04, 0.08, 0.32), iterations: int = 100, p: int = 5, p_most: int = 10, seed: int = 0) -> DataFrame:
    """One row a cell and iteration; q None stands for a random tree."""
    rows = [(k, a, b, "SCG" if c is None else f"{c:g}", -1.0 if c is None else float(c), i, p, p_most, seed) for k, (a, b, c, i) in enumerate(itertools.product(n, t, q, range(iterations)))]
    return spark.createDataFrame(rows, "id long, n int, t int, q string, prob double, iter int, p int, p_most int, seed long").repartition(len(rows), "id")


def measure(true: np.ndarray, found: list[tuple[int, int]], errors: np.ndarray, sv2: np.ndarray, compat: bool = True) -> dict[str, float]:
    n = true.shape[1]
    t = {(int(s), int(d)) for d, s in np.argwhere((true != 0).any(0)) if s != d}
    f = {(s, d) for s, d in found if s != d}
    tp, fp, fn = len(t & f), len(f - t), len(t - f)
    tn = (n * n - tp - fn - fn) if compat else n * (n - 1) - tp - fn - fp
    root = np.sqrt(float((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return {"mcc": (tp * tn - fp * fn) / root if root > 0 else float("nan"), "fdr": fp / (tp + fp) if tp + fp else float("nan"), "lre": float(np.log(errors.sum()) / np.log(sv2.sum()))}


def run(specs: DataFrame, algorithms: tuple[str, ...] = ("pwgc", "alasso"), out_of_sample: int = 500) -> DataFrame:
    """id, n, t, q, iter, algo, metric, value. Systems run where the rows of specs lie; a grid has a task for each."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in pdf.itertuples():
            x, b, sv2 = simulate.simulate("scg" if s.prob < 0 else "dag", int(s.n), int(s.t) + out_of_sample, int(s.p), float(s.prob), int(s.seed * 1_000_003 + s.id))
            x = x - x.mean(0)
            head = x[: int(s.t)]
            for algo in algorithms:
                if algo == "pwgc":
                    edges = pipeline.pwgc_arrays(head, int(s.p_most))
                else:
                    w, _ = pipeline.refit_arrays(head, [(i, j) for i in range(s.n) for j in range(s.n)], int(s.p_most), "alasso")
                    edges = [(int(u), int(v)) for v, u in np.argwhere((w != 0).any(0)) if u != v]
                _, r = pipeline.refit_arrays(x, edges, int(s.p_most), most=max(1, int(s.t) - int(s.p_most)))
                rows += [(s.id, s.n, s.t, s.q, s.iter, algo, k, v) for k, v in measure(b, edges, r.var(0), sv2).items()]
        return pd.DataFrame(rows, columns=["id", "n", "t", "q", "iter", "algo", "metric", "value"])

    return specs.mapInPandas(lambda batches: map(one, batches), "id long, n int, t int, q string, iter int, algo string, metric string, value double")


def table(results: DataFrame, a: str = "alasso", b: str = "pwgc") -> DataFrame:
    """Means of both algorithms by cell and metric, with the paired test's p-value."""
    keys = ["nodes", "steps", "q", "metric"]
    results = materialize(results, "results")  # drawn and fitted once, read for means and for tests
    wide = results.withColumnsRenamed({"n": "nodes", "t": "steps"}).groupBy(*keys, "iter").pivot("algo", [a, b]).agg(F.first("value"))
    means = wide.groupBy(*keys).agg(F.avg(a).alias(a), F.avg(b).alias(b))
    return means.join(metrics.paired_t(wide, keys, "iter", a, b).select(*keys, "p_value"), keys)


def over_time(spark: SparkSession, t=tuple(range(50, 5001, 25)), n: int = 50, q: float | None = None, iterations: int = 1, **more) -> DataFrame:
    """Both algorithms by length of the series."""
    return grid(spark, (n,), tuple(t), (q,), iterations, **more)


def short_series(spark: SparkSession, t=tuple(range(20, 101, 10)), n: int = 50, q: float | None = None, iterations: int = 10, **more) -> DataFrame:
    """The same where observations are few."""
    return over_time(spark, t, n, q, iterations, **more)


def over_nodes(spark: SparkSession, n=tuple(range(10, 1491, 10)), t: int = 500, iterations: int = 2, **more) -> DataFrame:
    """By number of nodes, in trees and in graphs of 2 / n and 4 / n links a pair; orders to 15."""
    parts = [grid(spark, (k,), (t,), (None, 2 / k, 4 / k), iterations, **({"p_most": 15, "seed": k} | more)) for k in n]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.repartition(max(1, len(n) * 3 * iterations), "n", "id")


def over_density(spark: SparkSession, q=tuple(np.geomspace(0.01, 0.5, 40).round(4).tolist()), n: int = 50, t: int = 500, iterations: int = 4, **more) -> DataFrame:
    """By share of links. Scores without a value stay so."""
    return grid(spark, (n,), (t,), tuple(q), iterations, **more)


def tracked(results: DataFrame, by: str) -> DataFrame:
    """algo, metric, `by` (t, n or q), mean, deviation and number of values that are not NaN: what a study plots."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return results.groupBy("algo", "metric", by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"), F.count(v).alias("values"))
