"""Panels, refits and residuals of streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_panel(events: DataFrame, time: str, node: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, i and x per window and series; rows later than `late` are dropped. Times without zone are cast."""
    d = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = d.groupBy(F.window("_t", window), F.col(node).alias("i")).agg(F.sum(value).alias("x"))
    return g.select(F.col("window.start").alias("start"), "i", "x")


def residuals(steps: DataFrame, b: np.ndarray, names: list[str]) -> DataFrame:
    """One-step prediction errors of a known system. steps: system, t and xs (all series of a step).

    State is the last p steps of each system; steps of a batch are taken in order of t.
    """
    p, n = b.shape[:2]

    def go(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        z = np.array(state.get[0]).reshape(p, n) if state.exists else np.zeros((p, n))
        pdf = pd.concat(list(batches)).sort_values("t")
        rows = []
        for t, xs in zip(pdf["t"], pdf["xs"]):
            x = np.asarray(xs, float)
            rows.append((key[0], t, (x - np.einsum("kij,kj->i", b, z)).tolist()))
            z = np.vstack([x, z[:-1]])
        state.update((z.ravel().tolist(),))
        yield pd.DataFrame(rows, columns=["system", "t", "r"])

    return steps.groupBy("system").applyInPandasWithState(go, "system string, t long, r array<double>", "z array<double>", "append", "NoTimeout")


def refit_on_windows(stream: DataFrame, refit, checkpoint: str):
    """Run refit(batch, id) on every micro-batch of a windowed stream; the caller starts and stops the query."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(refit)
