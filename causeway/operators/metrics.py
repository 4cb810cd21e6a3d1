"""How well a graph or a prediction matches the truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def confusion(true: DataFrame, found: DataFrame, nodes: int, compat: bool = False) -> DataFrame:
    """One row tp, fp, fn, tn, loops aside. compat: n squared possible edges, and tn counted as N - fn."""
    t, f = (x.filter("src <> dst").select("src", "dst").distinct() for x in (true, found))
    both = t.withColumn("_t", F.lit(1)).join(f.withColumn("_f", F.lit(1)), ["src", "dst"], "full_outer")
    c = both.agg(*[F.count_if(x).alias(n) for n, x in (("tp", F.col("_t").isNotNull() & F.col("_f").isNotNull()), ("fp", F.col("_t").isNull()), ("fn", F.col("_f").isNull()))])
    possible = F.lit(nodes * nodes if compat else nodes * (nodes - 1))
    negative = possible - F.col("tp") - F.col("fn")
    return c.withColumn("tn", negative - F.col("fn" if compat else "fp"))


def _ratio(a: Column, b: Column) -> Column:
    """NaN where the divisor is 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.when(b != 0, b))


def scores(c: DataFrame) -> DataFrame:
    """c with f1, mcc and fdr."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fdr": _ratio(fp, tp + fp),
    })


def log_relative_error(nodes: DataFrame) -> DataFrame:
    """ln of the sum of estimated over ln of the sum of true error variances (sv2_hat, sv2)."""
    return nodes.agg((F.log(F.sum("sv2_hat")) / F.log(F.sum("sv2"))).alias("lre"))


def filter_error(errors: DataFrame) -> DataFrame:
    """Mean over edges of the variance of the coefficients' errors (err)."""
    m = F.aggregate("err", F.lit(0.0), lambda s, v: s + v) / F.size("err")
    v = F.aggregate("err", F.lit(0.0), lambda s, x: s + x * x) / F.size("err") - m * m
    return errors.agg(F.avg(v).alias("error"))


def paired_t(results: DataFrame, keys: list[str], pair: str, a: str, b: str) -> DataFrame:
    """keys, n, mean difference a - b, t statistic and two-sided p-value over rows that share keys and pair."""
    d = results.groupBy(*keys, pair).agg(F.max(a).alias("_a"), F.max(b).alias("_b")).withColumn("_d", F.col("_a") - F.col("_b"))
    s = d.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("diff"), F.stddev_samp("_d").alias("_s"))
    s = s.withColumn("t", F.when(F.col("_s") > 0, F.col("diff") / (F.col("_s") / F.sqrt("n")))).drop("_s")

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(2 * (1 - special.t_cdf(t.abs().to_numpy(float), (n - 1).clip(lower=1).to_numpy(float))))

    return s.withColumn("p_value", two_sided("t", "n"))


def confusion_by_class(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, count and its share of the true class."""
    c = rows.groupBy(truth, guess).agg(F.count("*").alias("c"))
    return c.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(truth)))


def multiclass_mcc(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy, mcc and the prevalence of the most frequent class."""
    t = rows.groupBy(F.col(truth).alias("k")).agg(F.count("*").alias("t"))
    p = rows.groupBy(F.col(guess).alias("k")).agg(F.count("*").alias("p"))
    tp = t.join(p, "k", "full_outer").select(F.coalesce("t", F.lit(0)).cast("double").alias("t"), F.coalesce("p", F.lit(0)).cast("double").alias("p"))
    s = tp.agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.max("t").alias("top"))
    n = rows.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(truth) == F.col(guess)).cast("double").alias("c"))
    j = n.crossJoin(s)
    return j.select((F.col("c") / F.col("n")).alias("accuracy"), _ratio(F.col("c") * F.col("n") - F.col("tp"), F.sqrt((F.col("n") ** 2 - F.col("pp")) * (F.col("n") ** 2 - F.col("tt")))).alias("mcc"), (F.col("top") / F.col("n")).alias("prevalence"))


def stratified_split(rows: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """rows with is_test: the same share of every label, chosen by a hash of the key.

    md5 orders the rows of a label. Rows are ranked within ranges of md5 and shifted by the rows of the ranges
    before, so that a label with most of the rows is ranked by many tasks.
    """
    code = F.md5(F.col(key).cast("string").cast("binary"))
    # The row goes apart, so that no name of its columns can clash.
    dealt = rows.select(F.struct("*").alias("row"), F.col(label).alias("label"), F.col(key).alias("key"), code.alias("code"))
    dealt = dealt.withColumn("range", F.coalesce(F.substring("code", 1, 2), F.lit("")))
    w = Window.partitionBy("of")
    sizes = dealt.groupBy(F.col("label").alias("of"), F.col("range").alias("at")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sizes = sizes.select("of", "at", before.alias("before"), F.sum("n").over(w).alias("total"))
    own = F.row_number().over(Window.partitionBy("label", "range").orderBy("code", "key"))
    ranked = dealt.withColumn("own", own).join(sizes, F.col("label").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    return ranked.select("row.*", (F.col("own") + F.col("before") <= F.ceil(F.col("total") * F.lit(test))).alias("is_test"))


def pivot_metrics(results: DataFrame, keys: list[str], metric: str = "metric", value: str = "value", names: list[str] | None = None) -> DataFrame:
    return results.groupBy(*keys).pivot(metric, names).agg(F.avg(value)).orderBy(*keys)


def melt(results: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return results.unpivot(keys, columns, "metric", "value")
