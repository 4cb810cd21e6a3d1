"""Pairwise tests as relations: scores, edge probabilities, false discovery, candidates and thresholds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def bic(error: Column, p: Column, t: Column, s: int) -> Column:
    return -F.log(error) - s * p * F.log(t) / t


def gc_score(xi: Column, xi_pair: Column, p: Column, t: Column, f_mode: bool = False) -> Column:
    """T (xi / xi_pair - 1) / p, 0 for order 0 (and T - p in place of T for the F distribution)."""
    return F.when(p == 0, F.lit(0.0)).otherwise((t - p if f_mode else t) * (xi / xi_pair - 1) / p)


def lr_score(xi: Column, xi_pair: Column, t: Column) -> Column:
    return t * F.log(xi / xi_pair)


def chi2_cdf_even(x: Column, p: int) -> Column:
    """Chi-square distribution function of even order p, closed form."""
    y, term = x / 2, F.lit(1.0)
    total = term
    for k in range(1, p // 2):
        term = term * y / k
        total = total + term
    return F.when(x > 0, 1 - F.exp(-y) * total).otherwise(0.0)


def edge_probability(tests: DataFrame, t: int | None = None, f_mode: bool = False) -> DataFrame:
    """tests (f, p) with p_edge."""

    @F.pandas_udf("double")
    def sure(f: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(special.edge_probability(f.to_numpy(), p.to_numpy(), t, f_mode))

    return tests.withColumn("p_edge", sure("f", "p"))


def score_pairs(pairs: DataFrame, t: int, f_mode: bool = False, f_cdf: bool | None = None) -> DataFrame:
    scored = pairs.withColumn("f", gc_score(F.col("xi"), F.col("xi_pair"), F.col("p"), F.lit(t), f_mode))
    return edge_probability(scored, t, f_mode if f_cdf is None else f_cdf)


def ranked(tests: DataFrame, order: list[str]) -> DataFrame:
    """rn, the place of each row in the whole order, and m, the number of rows.

    Rows are dealt by range; each range is ranked in its own task and shifted by the rows before it.
    """
    dealt = tests.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()).persist()
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part")
    base = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(base), F.col("_part") == F.col("_p")).withColumn("rn", F.col("_own") + F.col("_before")).drop("_part", "_p", "_own", "_before")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m, by its asymptotic series from 32 on (off by less than 1e-14)."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(32)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)
    x = m.cast("double")
    many = F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(m <= 32, few).otherwise(many)


def bh_threshold(tests: DataFrame, alpha: float, order: list[str], compat: bool = True, independent: bool = True) -> DataFrame:
    """One row, threshold: the p-value (column p_value) at the place that Benjamini and Hochberg's rule picks."""
    c = F.lit(1.0) if independent else harmonic(F.col("m"))
    r = ranked(tests.select("p_value", *[o for o in order if o != "p_value"]), order)
    line = F.col("rn") * F.lit(alpha) / (c * F.col("m"))
    if not compat:
        return r.agg(F.coalesce(F.max(F.when(F.col("p_value") <= line, F.col("p_value"))), F.lit(0.0)).alias("threshold"))
    # One of the two sides begins at place 1; the place before the other begins is the one wanted, or else place 1.
    side = r.select("rn", "p_value", (F.col("p_value") < line).alias("below"))
    begin = side.agg(*[F.min(F.when(b, F.col("rn"))).alias(n) for n, b in (("low", F.col("below")), ("high", ~F.col("below")))])
    place = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.greatest("low", "high") - 1).otherwise(1)
    return side.crossJoin(F.broadcast(begin.select(place.alias("place")))).filter("rn = place").select(F.col("p_value").alias("threshold"))  # one row


def threshold_edges(tests: DataFrame, threshold: DataFrame) -> DataFrame:
    """Edges whose probability is positive and at least 1 - threshold."""
    return tests.crossJoin(F.broadcast(threshold)).filter((F.col("p_edge") > 0) & (F.col("p_edge") >= 1 - F.col("threshold"))).select("src", "dst")


def candidates(tests: DataFrame, floor: float = 0.0, drop_bidirectional: bool = False) -> DataFrame:
    """Edges (src, dst, f, p_edge) that point the stronger way."""
    kept = tests.withColumn("p_edge", F.when(F.col("p_edge") < floor, 0.0).otherwise(F.col("p_edge")))
    back = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("f").alias("f_back"), F.col("p_edge").alias("p_back"))
    both = kept.join(back, ["src", "dst"]).filter("f >= f_back AND p_edge > 0")
    return (both.filter("p_back = 0") if drop_bidirectional else both).select("src", "dst", "f", "p_edge")


def incident_strength(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """i and c, the sum of probabilities of candidate edges into it."""
    return nodes.join(edges.groupBy(F.col("dst").alias("i")).agg(F.sum("p_edge").alias("c")), "i", "left").select("i", F.coalesce("c", F.lit(0.0)).alias("c"))


def first_layer(strength: DataFrame) -> DataFrame:
    """Nodes below the rounded-up minimum, or at most it if there are none."""
    least = strength.agg(F.ceil(F.min("c")).alias("m"))
    d = strength.crossJoin(F.broadcast(least))
    any_below = d.agg(F.max((F.col("c") < F.col("m")).cast("int")).alias("any"))
    return d.crossJoin(F.broadcast(any_below)).filter("c < m OR (any = 0 AND c <= m)").select("i")
