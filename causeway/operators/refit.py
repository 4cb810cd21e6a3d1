"""Filters on a known topology: each node's series fitted on its predecessors' lags, nodes apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import autoregression as ar
from ..sources.tables import spread
from . import graph, panel

#: Values of all series together (8 bytes each) up to which they are broadcast.
SHARED_VALUES = 4_000_000


def estimate(edges: DataFrame, series: DataFrame, p: int, method: str = "lstsqr", most: int | None = None) -> DataFrame:
    """dst, sv2_hat, r (residuals), srcs and b (one filter of p lags a source).

    most: fit on the first `most` rows of the lagged matrix and take residuals on the rest; else in sample.
    A node without predecessors keeps its variance.
    """
    kind, spark = dict(series.dtypes)["i"], series.sparkSession
    own = series.select(F.col("i").alias("dst"), F.col("xs").alias("y"))
    # Where all series together are small (counted first), each task gets them once; else they are joined to the edges.
    size = series.agg(F.sum(F.size("xs"))).first()[0] or 0
    shared = None
    if size <= SHARED_VALUES:
        shared = spark.sparkContext.broadcast({r["i"]: np.asarray(r["xs"], float) for r in series.select("i", "xs").toLocalIterator()})
        names = edges.join(series.select(F.col("i").alias("src")), "src", "left_semi").groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("names"))
        own = own.join(names, "dst", "left")
    else:
        own = own.join(graph.parents(edges, series), "dst", "left")

    def apply(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                y = np.asarray(r.y, float)
                names, b, res = [], [], y[(most or 0) + p :]
                from_ = r.parents if shared is None else r.names
                if from_ is None or not len(from_):
                    rows.append((r.dst, float(np.var(y)), res, names, b))
                    continue
                names = [s["src"] for s in from_] if shared is None else list(from_)
                values = [np.asarray(s["xs"], float) for s in from_] if shared is None else [shared.value[s] for s in names]
                x, t = ar.lagged(np.stack(values, 1), y, p)
                w = ar.fit(method, x[:most], t[:most], p)
                res = t[most:] - x[most:] @ w
                rows.append((r.dst, float(np.var(res)) if len(res) else float("nan"), res, names, [w[k * p : (k + 1) * p] for k in range(len(names))]))
            yield pd.DataFrame(rows, columns=["dst", "sv2_hat", "r", "srcs", "b"])

    return spread(own, "dst").mapInPandas(apply, f"dst {kind}, sv2_hat double, r array<double>, srcs array<{kind}>, b array<array<double>>")


def filters(fitted: DataFrame) -> DataFrame:
    """(src, dst, b) of every fitted edge."""
    return fitted.select("dst", F.explode(F.arrays_zip("srcs", "b")).alias("e")).select(F.col("e.srcs").alias("src"), "dst", F.col("e.b").alias("b"))


def residual_series(fitted: DataFrame) -> DataFrame:
    return fitted.select(F.col("dst").alias("i"), F.col("r").alias("xs"))


def one_step_residuals(panel_: DataFrame, edges: DataFrame, p: int) -> DataFrame:
    """t, i and r, what filters (src, dst, b of p lags) leave of a panel; steps with p steps before them only."""
    lags = panel.lag_matrix(panel_, p)
    terms = F.aggregate(F.zip_with("b", "lags", lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
    said = lags.join(edges, F.col("i") == F.col("src")).groupBy(F.col("dst").alias("i"), "t").agg(F.sum(terms).alias("said"))
    return lags.select("t", "i", "x").join(said, ["i", "t"], "left").select("t", "i", (F.col("x") - F.coalesce("said", F.lit(0.0))).alias("r"))


def ar_baseline(series: DataFrame, p: int, most: int) -> DataFrame:
    """i, order and out-of-sample error of an autoregression of its own, fitted on the first `most` values."""
    kind = dict(series.dtypes)["i"]

    def apply(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x = np.asarray(r.xs, float)
                cov = ar.covariances(x[:most, None], p)[:, 0, 0][None, :]
                _, order = ar.univariate(cov, most)
                k = int(order[0])
                _, b = ar.levinson(cov[:, : k + 1])
                z, y = ar.lagged(x, x, k) if k else (np.zeros((len(x), 0)), x)
                e = (y - z @ b[0])[max(0, most - k) :]
                rows.append((r.i, k, float(np.var(e)) if len(e) else float("nan"), float(np.var(x[most:])) if len(x) > most else float("nan")))
            yield pd.DataFrame(rows, columns=["i", "p", "error", "variance"])

    return series.mapInPandas(apply, f"i {kind}, p int, error double, variance double")
