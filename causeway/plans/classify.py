"""Classification of groups by their graphs: adjacency features, kernel map, normal quantiles, logistic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics


def features(edges: DataFrame, groups: DataFrame, keys: list[str], nodes: list) -> DataFrame:
    """groups with features: the adjacency matrix, row by row, loops aside."""
    at = {n: k for k, n in enumerate(nodes)}
    place = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])
    e = edges.filter("src <> dst").select(*keys, (place[F.col("src")] * len(nodes) + place[F.col("dst")]).cast("int").alias("c"))
    on = e.groupBy(*keys).agg(F.array_sort(F.collect_set("c")).alias("on"))
    size = len(nodes) ** 2

    @F.pandas_udf("array<double>")
    def dense(on: pd.Series) -> pd.Series:
        out = np.zeros((len(on), size))
        for k, cells in enumerate(on):
            if cells is not None and len(cells):
                out[k, np.asarray(cells)] = 1.0
        return pd.Series(list(out))

    return groups.join(on, keys, "left").withColumn("features", dense("on")).drop("on")


def nystroem(rows: DataFrame, parts: int = 32, degree: int = 2, key: str = "id", learn=None) -> DataFrame:
    """Polynomial kernel map by landmarks, chosen by a hash of the key among rows that `learn` holds for (bounded: `parts` rows reach the driver)."""
    marks = np.array([r[0] for r in (rows if learn is None else rows.filter(learn)).orderBy(F.md5(F.col(key).cast("string").cast("binary"))).select("features").limit(parts).collect()])
    gamma = 1 / marks.shape[1]
    values, vectors = np.linalg.eigh((gamma * marks @ marks.T + 1) ** degree)
    root = vectors / np.sqrt(np.maximum(values, 1e-10))

    @F.pandas_udf("array<double>")
    def project(x):
        return x.apply(lambda v: ((gamma * marks @ np.asarray(v) + 1) ** degree @ root).tolist())

    return rows.withColumn("features", project("features"))


def normal_quantiles(rows: DataFrame, width: int, knots: int = 101, learn=None) -> DataFrame:
    """Each feature to a normal score by interpolated quantiles, which are partially aggregated sketches."""
    from statistics import NormalDist

    q = [k / (knots - 1) for k in range(knots)]
    got = (rows if learn is None else rows.filter(learn)).agg(*[F.percentile_approx(F.col("features")[k], q, 10_000) for k in range(width)]).first()
    tables = np.array(got, float)
    z = np.array([NormalDist().inv_cdf(min(max(x, 1e-4), 1 - 1e-4)) for x in q])

    @F.pandas_udf("array<double>")
    def score(x):
        return x.apply(lambda v: [float(np.interp(a, t, z)) if t[0] < t[-1] else 0.0 for a, t in zip(v, tables)])

    return rows.withColumn("features", score("features"))


def classify(rows: DataFrame, label: str, key: str, test: float = 0.2, grid=(0.01, 0.1), folds: int = 3) -> DataFrame:
    """key, label and prediction (as the label) of the held-out rows; classes are weighted to balance."""
    split = metrics.stratified_split(rows, label, key, test).persist()
    train = split.filter("NOT is_test")
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep").fit(train)
    w = Window.partitionBy(label)
    ready = index.transform(train).withColumn("_w", 1 / F.count("*").over(w)).withColumn("_x", array_to_vector("features"))
    lr = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_w", maxIter=50)
    space = ParamGridBuilder().addGrid(lr.regParam, list(grid)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=space, evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="f1"), numFolds=folds, seed=1)
    model = cv.fit(ready).bestModel if len(space) > 1 else lr.fit(ready)
    got = model.transform(index.transform(split.filter("is_test")).withColumn("_x", array_to_vector("features")))
    names = F.array(*[F.lit(x) for x in [*index.labels, "unknown"]])
    return got.select(key, F.col(label).cast("string").alias("label"), F.get(names, F.col("prediction").cast("int")).alias("prediction"))


def searched(rows: DataFrame, label: str, key: str, test: float = 0.2, tries: int = 12, folds: int = 3, parts=(30, 60), degrees=(3, 4, 5), seed: int = 0) -> tuple[DataFrame, dict]:
    """Held-out predictions of a kernel map, normal quantiles and logistic regression, and the parameters that they have.

    A random search: `tries` draws of landmarks, degree and penalty, each scored by the Matthews coefficient of
    predictions of training rows by models fitted on the other folds (by a hash of the key).
    """
    rng = np.random.default_rng(seed)
    split = metrics.stratified_split(rows, label, key, test).persist()
    train, held = split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")
    fold = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds))
    best: tuple[float, dict] = (-np.inf, {})
    for _ in range(tries):
        how = {"parts": int(rng.choice(parts)), "degree": int(rng.choice(degrees)), "penalty": float(10 ** rng.uniform(-4, 0))}
        guesses = None
        for k in range(folds):
            one = _fitted(train.filter(fold != k), train.filter(fold == k), label, key, **how)
            guesses = one if guesses is None else guesses.union(one)
        score = metrics.multiclass_mcc(guesses, "label", "prediction").first()["mcc"]
        if score is not None and score == score and score > best[0]:
            best = score, how
    how = best[1] or {"parts": parts[0], "degree": degrees[0], "penalty": 0.1}
    return _fitted(train, held, label, key, **how), how


def _fitted(train: DataFrame, test: DataFrame, label: str, key: str, parts: int, degree: int, penalty: float) -> DataFrame:
    """key, label and prediction of test; maps and quantiles are learned from train alone."""
    both = train.withColumn("_test", F.lit(False)).union(test.withColumn("_test", F.lit(True)))
    mapped = nystroem(both, parts, degree, key, F.col("_test") == F.lit(False))
    width = len(mapped.select("features").first()[0])
    ready = normal_quantiles(mapped, width, learn=F.col("_test") == F.lit(False)).persist()
    known = ready.filter("NOT _test")
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep").fit(known)
    known = index.transform(known).withColumn("_w", 1 / F.count("*").over(Window.partitionBy(label))).withColumn("_x", array_to_vector("features"))
    model = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_w", regParam=penalty, maxIter=100).fit(known)
    got = model.transform(index.transform(ready.filter("_test")).withColumn("_x", array_to_vector("features")))
    names = F.array(*[F.lit(x) for x in [*index.labels, "unknown"]])
    return got.select(key, F.col(label).cast("string").alias("label"), F.get(names, F.col("prediction").cast("int")).alias("prediction"))


def binary(rows: DataFrame, label: str, positive: str, key: str, **how) -> DataFrame:
    """One row: mcc, accuracy and prevalence of a searched classifier of one class against the rest."""
    two = rows.withColumn("_class", F.when(F.col(label) == positive, F.lit("yes")).otherwise(F.lit("no")))
    got, _ = searched(two, "_class", key, **how)
    return metrics.multiclass_mcc(got, "label", "prediction")


def subject_pair(rows: DataFrame, a: str, b: str, label: str, key: str, **how) -> DataFrame:
    """One row: how well two subjects are told apart (mcc, accuracy, prevalence) by a searched classifier."""
    got, _ = searched(rows.filter(F.col(label).isin(a, b)), label, key, **({"tries": 2} | how))
    return metrics.multiclass_mcc(got, "label", "prediction")
