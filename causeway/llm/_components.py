"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, map_arrow, materialize

#: Rounds grow with the logarithm of the longest chain of links; this many would not do for any table that fits a disk.
MOST_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest node that these links join it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def contract(links: DataFrame) -> DataFrame:
    """Per task: the same connections by fewer links."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(links.select("a", "b"), apply, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it is connected to; only nodes that have links and are not roots.

    links: a and b, long. A hub's links are joined to one row of the hub, which AQE can split; minima are
    partially aggregated, so the largest component costs a task no more than another.
    """
    now = materialize(contract(links).filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        last, now = now, materialize(small.select("x.a", "x.b").filter("a <> b").distinct(), "links")
        discard(last)
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
