"""Panels: long frames of (t, i, x), one row a time step and series, and what cleans and shapes them."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import screen


def by_time():
    """Each series in order of time."""
    return Window.partitionBy("i").orderBy("t")


def densify(events: DataFrame, step: int, time: str = "t", node: str = "i", value: str = "x") -> DataFrame:
    """Every step from the first to the last for every series, sums of value where there are rows, else 0.

    time: whole seconds, hours or days as a long; step divides it. Bounds are one row, so nothing is crossed but that.
    """
    own = events.groupBy(F.floor(F.col(time) / step).cast("long").alias("k"), F.col(node).alias("i")).agg(F.sum(value).alias("x"))
    bounds = own.agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    grid = own.select("i").distinct().crossJoin(F.broadcast(bounds)).select("i", "lo", F.explode(F.sequence("lo", "hi")).alias("k"))
    return grid.join(own, ["k", "i"], "left").select((F.col("k") - F.col("lo")).alias("t"), "i", F.coalesce("x", F.lit(0)).alias("x"))


def summed_steps(events: DataFrame, step: int, time: str = "t", node: str = "i", value: str = "x") -> DataFrame:
    """As densify(), one row a series and without the steps of sum 0: i, lo and hi (first and last step with rows), s1 and s2
    (sum and sum of squares, exact for whole numbers), at (steps whose sum is not 0, in order) and xs (their sums).

    Rows without a time count for nothing. A series of null name stays, as its steps count for the bounds of all.
    """
    own = events.filter(F.col(time).isNotNull()).groupBy(F.floor(F.col(time) / step).cast("long").alias("k"), F.col(node).alias("i")).agg(F.sum(value).alias("x"))
    kept = F.sort_array(F.collect_list(F.when(F.col("x") != 0, F.struct("k", "x"))))
    rows = own.groupBy("i").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"), kept.alias("_s"))
    return rows.select("i", "lo", "hi", "s1", "s2", F.col("_s.k").alias("at"), F.col("_s.x").alias("xs"))


def digested(steps: DataFrame) -> DataFrame:
    """summed_steps() with digest, the SHA-256 of all steps and sums."""
    return steps.withColumn("digest", F.unhex(F.sha2(F.concat_ws(";", F.col("at").cast("string"), F.col("xs").cast("string")), 256)))


def by_class(steps: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """Of digested(): one row a class of equal series, and the members of all classes; series that do not vary are gone.

    The first: i (the class's least name), copies, m and d (mean and deviation over lo..hi), at and xs. The second: i, rep.
    Classes are of equal digest.
    """
    n, s1, s2 = F.lit(float(hi - lo + 1)), F.col("s1").cast("double"), F.col("s2").cast("double")
    varied = steps.select("i", "at", "xs", (s1 / n).alias("m"), F.sqrt((n * s2 - s1 * s1) / (n * n)).alias("d"), "digest").filter("i IS NOT NULL AND d > 0")
    least = varied.groupBy("digest").agg(F.min("i").alias("rep"), F.count("*").alias("copies"))
    members = varied.select("i", "digest").join(least, "digest").select("i", "rep")
    return varied.join(least.select(F.col("rep").alias("i"), "copies"), "i").select("i", "copies", "m", "d", "at", "xs"), members


def packed(classes: DataFrame, lo: int, hi: int, p: int) -> DataFrame:
    """i, copies and xs: each series of by_class() in a few bytes, with its autocovariances to lag p; see unpacked()."""
    kind = dict(classes.dtypes)["i"]

    def one(r, z, own, least) -> bytes:
        at = np.diff(np.asarray(r.at, "i8"), prepend=lo).astype("i4").view("u1").reshape(-1, 4).T
        xs = np.asarray(r.xs, float).view("u1").reshape(-1, 8).T  # bytes of a place together, as most are alike
        return np.concatenate([[r.m, r.d], own, least]).tobytes() + zlib.compress(at.tobytes() + xs.tobytes(), 1)

    def apply(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf[s : s + 256]
                z = np.stack([_whole(r.m, r.d, np.asarray(r.at) - lo, np.asarray(r.xs, float), hi - lo + 1) for r in part.itertuples()])
                own = np.stack([(z[:, k:] * z[:, : max(0, z.shape[1] - k)]).sum(1) / z.shape[1] for k in range(p + 1)], 1)
                rows = [one(*each) for each in zip(part.itertuples(), z, own, screen.least_eigenvalues(own))]
                yield pd.DataFrame({"i": part["i"], "copies": part["copies"], "xs": rows})

    return classes.mapInPandas(apply, f"i {kind}, copies long, xs binary")


def _whole(m: float, d: float, at: np.ndarray, xs: np.ndarray, t: int) -> np.ndarray:
    z = np.full(t, (0 - m) / d)
    z[at] = (xs - m) / d
    return z


def covariances_of(rows, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Of packed(): autocovariances (rows, p + 1) and their least eigenvalues by order (rows, p)."""
    head = np.stack([np.frombuffer(r, float, 2 * p + 1, 16) for r in rows]) if len(rows) else np.zeros((0, 2 * p + 1))
    return head[:, : p + 1], head[:, p + 1 :]


def unpacked(rows, t: int, p: int) -> np.ndarray:
    """Of packed(): the whole standardised series (rows, t)."""
    out = np.empty((len(rows), t))
    for k, r in enumerate(rows):
        m, d = np.frombuffer(r, float, 2)
        body = np.frombuffer(zlib.decompress(memoryview(r)[8 * (2 * p + 3) :]), "u1")
        n = len(body) // 12
        at = np.ascontiguousarray(body[: 4 * n].reshape(4, n).T).view("i4").ravel().cumsum()
        out[k] = _whole(m, d, at, np.ascontiguousarray(body[4 * n :].reshape(8, n).T).view(float).ravel(), t)
    return out


def standardised(packed_: DataFrame, t: int, p: int) -> DataFrame:
    """i, copies and xs, the whole series less its mean, by its deviation: as to_series(zscore(densify()))."""
    kind = dict(packed_.dtypes)["i"]

    def apply(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf[s : s + 256]
                yield pd.DataFrame({"i": part["i"], "copies": part["copies"], "xs": list(unpacked(part["xs"].tolist(), t, p))})

    return packed_.mapInPandas(apply, f"i {kind}, copies long, xs array<double>")


def moments(panel: DataFrame) -> DataFrame:
    """Per series: n, the sum and the sum of squares (exact for whole numbers)."""
    return panel.groupBy("i").agg(F.count("x").alias("n"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))


def demean(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("i")
    return panel.withColumn("x", F.col("x") - F.sum("x").over(w) / F.count("x").over(w))


def zscore(panel: DataFrame, sample: bool = False) -> DataFrame:
    """(x - mean) / deviation of each series; constant series are dropped. sample: divide by n - 1."""
    n, s1, s2 = (F.col(c).cast("double") for c in ("n", "s1", "s2"))
    m = moments(panel).select("i", (s1 / n).alias("m"), F.sqrt((n * s2 - s1 * s1) / (n * (n - (1 if sample else 0)))).alias("d"))
    return panel.join(m.filter("d > 0"), "i").select("t", "i", ((F.col("x") - F.col("m")) / F.col("d")).alias("x"))


def lag_matrix(panel: DataFrame, p: int) -> DataFrame:
    """lags: x at t-1 .. t-p; rows with fewer are left out."""
    cols = [F.lag("x", k).over(by_time()) for k in range(1, p + 1)]
    return panel.select("t", "i", "x", F.array(*cols).alias("lags")).filter(F.get("lags", F.lit(p - 1)).isNotNull())


def first_difference(panel: DataFrame) -> DataFrame:
    return panel.withColumn("x", F.col("x") - F.lag("x").over(by_time()))


def log_return(panel: DataFrame) -> DataFrame:
    """Difference of logarithms; what is not finite becomes null."""
    safe = F.when(F.col("x") > 0, F.log("x"))
    return panel.withColumn("x", safe - F.lag(safe).over(by_time()))


def ewm_mean(panel: DataFrame, halflife: float, reach: int | None = None) -> DataFrame:
    """Exponentially weighted mean with adjusted weights, over the last `reach` values.

    By default 128 half-lives: what lies before weighs less than 2 ** -128, so a step costs the same in any series.
    """
    w = by_time().rowsBetween(1 - (reach or max(1, math.ceil(128 * halflife))), 0)
    keep = 0.5 ** (1 / halflife)
    seen = F.collect_list("x").over(w)
    at = lambda a: F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda c, x: F.struct((c.s * keep + x).alias("s"), (c.w * keep + 1).alias("w")), lambda c: c.s / c.w)
    return panel.withColumn("_seen", seen).withColumn("x", at(F.col("_seen"))).drop("_seen")


def forward_fill(panel: DataFrame) -> DataFrame:
    return panel.withColumn("x", F.last("x", ignorenulls=True).over(by_time()))


def fill_both(panel: DataFrame) -> DataFrame:
    """Forward, then backward."""
    back = F.first("x", ignorenulls=True).over(by_time().rowsBetween(0, Window.unboundedFollowing))
    return panel.withColumn("x", F.coalesce(F.last("x", ignorenulls=True).over(by_time()), back))


def interpolate(panel: DataFrame) -> DataFrame:
    """Linear by row position between known values, then forward and backward fill."""
    d = panel.withColumn("_n", F.row_number().over(by_time()))
    known = F.when(F.col("x").isNotNull(), F.struct("_n", "x"))
    after = by_time().rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_a", F.last(known, ignorenulls=True).over(by_time())).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col("_n") - F.col("_a._n")) / (F.col("_b._n") - F.col("_a._n"))
    return d.select("t", "i", F.coalesce("x", line, F.col("_a.x"), F.col("_b.x")).alias("x"))


def volume_filter(rows: DataFrame, key: str, volume: str, least: float) -> DataFrame:
    """Rows of keys whose mean volume is at least this."""
    good = rows.groupBy(key).agg(F.avg(volume).alias("_v")).filter(F.col("_v") >= least).select(key)
    return rows.join(good, key, "left_semi")


def coverage_filter(rows: DataFrame, key: str, time: str, first, last) -> DataFrame:
    """Rows of keys that start by `first` and go on until `last`."""
    good = rows.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).filter((F.col("_lo") <= first) & (F.col("_hi") >= last)).select(key)
    return rows.join(good, key, "left_semi")


def between(rows: DataFrame, time: str, first, last) -> DataFrame:
    """Both ends included."""
    return rows.filter(F.col(time).between(first, last))


def repair(rows: DataFrame, key: str, time: str, columns: list[str], skip: int = 50) -> DataFrame:
    """Drop keys with a column without values, fill forward, drop each key's first `skip` dates, then fill with the mean."""
    whole = Window.partitionBy(key)
    order = whole.orderBy(time)
    for c in columns:
        rows = rows.withColumn(f"_n_{c}", F.count(c).over(whole))
    rows = rows.filter(" AND ".join(f"_n_{c} > 0" for c in columns))
    for c in columns:
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(order))
    rows = rows.withColumn("_k", F.dense_rank().over(order)).filter(F.col("_k") > skip)
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(c, F.avg(c).over(whole)))
    return rows.drop("_k", *[f"_n_{c}" for c in columns])


def minute_of_day(time: Column, opening: int = 570) -> Column:
    """Minutes since the opening (in minutes after midnight), wrapped to a day."""
    return F.pmod(F.hour(time) * 60 + F.minute(time) - opening, F.lit(1440))


def session_trim(rows: DataFrame, time: str, low: int = 100, high: int = 291) -> DataFrame:
    m = minute_of_day(F.col(time))
    return rows.withColumn("minute", m).withColumn("weekday", F.weekday(time)).filter((m > low) & (m < high))


def complete_cases(panel: DataFrame, series: int) -> DataFrame:
    """Steps at which all series have a value."""
    return panel.filter("x IS NOT NULL AND NOT isnan(x)").withColumn("_n", F.count("*").over(Window.partitionBy("t"))).filter(F.col("_n") == series).drop("_n")


def missing_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column and share of nulls and NaNs."""
    gone = lambda c: F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(c)
    return rows.agg(*[gone(c) for c in columns]).unpivot([], columns, "column", "share")


def normalise_trial(trial: DataFrame, keys: list[str], dither: float = 1e-2, seed: int = 0) -> DataFrame:
    """Subtract each channel's mean, divide by the trial's deviation (null if that is 0), add a little noise."""
    d = trial.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*keys, "i")))
    return d.withColumn("x", F.col("x") / F.nullif(F.stddev_pop("x").over(Window.partitionBy(*keys)), F.lit(0.0)) + dither * F.randn(seed))


def merge_outer(a: DataFrame, b: DataFrame, keys: list[str], backfill: list[str] = (), key: str | None = None) -> DataFrame:
    """Full outer join; columns to backfill take the next known value in the order of the last key."""
    out = a.join(b, keys, "full_outer")
    w = (Window.partitionBy(key) if key else Window.partitionBy(*keys[:-1])).orderBy(keys[-1]).rowsBetween(0, Window.unboundedFollowing)
    for c in backfill:
        out = out.withColumn(c, F.first(c, ignorenulls=True).over(w))
    return out


def on_calendar(rows: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    return rows.join(calendar, key, "left_semi")


def rolling_windows(rows: DataFrame, day: str, days: int, length: int) -> DataFrame:
    """window_id of every window of `length` consecutive days (0..days-1) that holds the row."""
    ids = F.sequence(F.greatest(F.lit(0), F.col(day) - (length - 1)), F.least(F.col(day), F.lit(days - length)))
    return rows.filter(F.greatest(F.lit(0), F.col(day) - (length - 1)) <= F.least(F.col(day), F.lit(days - length))).withColumn("window_id", F.explode(ids))


def to_series(panel: DataFrame) -> DataFrame:
    """(i, xs): each series as an array in order of time."""
    return panel.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.col("x").cast("double").alias("x")))), lambda r: r.x).alias("xs"))


def to_panel(series: DataFrame) -> DataFrame:
    return series.select("i", F.posexplode("xs").alias("t", "x")).select(F.col("t").cast("long").alias("t"), "i", "x")
