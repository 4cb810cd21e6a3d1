import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import autoregression as ar
from causeway.functions import screen
from causeway.operators import covariance, granger, panel
from causeway.plans import pipeline
from causeway.plans import queries as plans

SF = "/root/testdata/sf0.001"


def repeated(spark, folder, table, key, times):
    """The table as often as `times`, the key shifted so that no two copies share one."""
    d = spark.read.parquet(f"{SF}/{table}.parquet")
    last = d.agg(F.max(key)).first()[0] + 1
    d.crossJoin(spark.range(times).toDF("_c")).withColumn(key, F.col(key) + F.col("_c") * last).drop("_c").write.parquet(f"{folder}/{table}.parquet")
    return last


def same(a, b):
    return a.p == b.p and all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip((a.xi, a.xi_pair, a.f, a.p_edge), (b.xi, b.xi_pair, b.f, b.p_edge)))


def copies_do_not_multiply(spark, folder, query, table, key):
    once = {(r.src, r.dst): r for r in plans.QUERIES[query](spark, SF).collect() if r.kind == "pair"}
    last = repeated(spark, folder, table, key, 3)
    found = plans.QUERIES[query](spark, str(folder))
    by = {k: {(r.src, r.dst): r for r in found.filter(F.col("kind") == k).collect()} for k in ("pair", "copies", "member")}
    names = {s for s, _ in once}
    assert once and set(by["pair"]) == set(once) and all(same(r, once[k]) for k, r in by["pair"].items())
    assert set(by["member"]) == {(i + c * last, i) for i in names for c in (1, 2)}
    assert set(by["copies"]) == {(i, i) for i in names} and all(r.p == 0 and r.p_edge == 0 for r in by["copies"].values())
    n = 3 * len(names)
    assert pipeline.expanded(found).count() == n * (n - 1)


def test_copies_of_users_do_not_multiply_the_pairs(spark, tmp_path):
    copies_do_not_multiply(spark, tmp_path, "pairwise_gc_fast", "events", "user_id")


def test_copies_of_suppliers_do_not_multiply_the_pairs(spark, tmp_path):
    copies_do_not_multiply(spark, tmp_path, "pairwise_gc_lineitem", "lineitem", "l_suppkey")


def test_expanded_classes_are_the_pairs_of_all_series(spark):
    rng = np.random.default_rng(5)
    rows = [(t, i, int(v)) for i in range(4) for t, v in enumerate(rng.poisson(1.0, 80)) if v]
    rows += [(t + 1, "follows", 3 * v) for t, i, v in rows if i == 0]
    rows = [(t, str(i), v) for t, i, v in rows]
    rows += [(t, "copy", v) for t, i, v in rows if i == "2"] + [(t, "other copy", v) for t, i, v in rows if i == "2"]
    rows += [(7, "copy", 4), (7, "copy", -4), (3, "still", 2), (3, "still", -2), (None, "2", 9), (90, None, 1), (-2, "void", None)]  # sums of 0, no time, no name, no value
    e = spark.createDataFrame(rows, "t long, i string, x long")
    found = pipeline.tests_by_class(e, 1, 3).persist()
    assert {(r.src, r.dst) for r in found.filter("kind = 'member'").collect()} == {("copy", "2"), ("other copy", "2")}
    s = pipeline.prepared(panel.densify(e, 1)).persist()
    n, t = s.agg(F.count("*"), F.max(F.size("xs"))).first()
    want = {(r.src, r.dst): r for r in granger.score_pairs(covariance.pairwise(s, n, 3), t).collect()}
    got = {(r.src, r.dst): r for r in pipeline.expanded(found).collect()}
    assert (n, t) == (7, 93) and set(got) == set(want) and len(got) == 42
    assert all(same(got[k], want[k]) for k in want) and got["0", "follows"].p_edge > 0.99


def test_no_events_have_no_pairs(spark):
    assert pipeline.tests_by_class(spark.createDataFrame([], "t long, i long, x long"), 1, 3).count() == 0
    one = spark.createDataFrame([(t, 5, t % 3) for t in range(9)], "t long, i long, x long")
    assert pipeline.tests_by_class(one, 1, 3).count() == 0


def test_recursion_of_two_series_equals_the_general_one():
    x = np.random.default_rng(2).standard_normal((6, 400))
    x[1, 2:] += x[0, :-2]
    x[2] = -3 * x[0]
    p, pairs = 5, [(0, 1), (1, 3), (3, 4), (5, 2)]
    r = np.stack([ar.covariances(x[list(k)].T, p) for k in pairs])
    assert np.allclose(ar.whittle_of_two(r), ar.whittle(r)[0], atol=1e-12)
    # copies, whatever their scale, leave no error of both: order 0
    a, b, order = ar.bivariate(np.stack([ar.covariances(x[[0, 0]].T, p), ar.covariances(x[[0, 2]].T, p)]), 400)
    assert order.tolist() == [0, 0] and np.allclose(b / a, [1, 9])


def uneven(series, t, seed=3):
    """Series of few and large steps, some of which follow another, or themselves."""
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.2, (series, t)) * rng.integers(1, 40, (series, t))
    for i in range(0, series, 5):
        x[i, 2:] += x[i + 1, :-2]
    for i in range(2, series, 10):
        x[i] = 50 + np.convolve(x[i], [3, 2, 2, 1], "full")[:t]
    return x


def test_screen_leaves_every_pair_of_an_order():
    p, x = 5, uneven(60, 400).astype(float)
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    t, own = x.shape[1], np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(1) / x.shape[1] for k in range(p + 1)], 1)
    test, least = screen.Screen(t, p), screen.least_eigenvalues(own)
    each = test.own(own, least)
    i, j, c = test.may(test.left(x[:25]), test.right(x), each[:, :, :25], each)
    lags = np.stack([np.pad(x, ((0, 0), (p, p)))[:, p - k : p - k + t] for k in range(-p, p + 1)])  # x(t - k)
    assert np.abs(c - np.einsum("at,kbt->kab", x[:25], lags)[:, i, j] / t).max() < 2 * test.off
    keep = test.still(c, each[:, :, i], each[:, :, j])
    left = set(zip(i[keep].tolist(), j[keep].tolist()))
    a, b = (v.ravel() for v in np.meshgrid(range(25), range(60), indexing="ij"))
    order = ar.bivariate(np.stack([ar.covariances(x[[u, v]].T, p) for u, v in zip(a, b)]), t)[2]
    over = {(u, v) for u, v, m in zip(a.tolist(), b.tolist(), order) if m > 0}
    assert over and over <= left and len(left) < len(a)
    assert {(u, u) for u in range(25)} <= left  # nothing is shown of a series and itself


@pytest.mark.parametrize("side", [128, 7])
def test_pairs_left_out_have_order_zero(spark, monkeypatch, side):
    """What is written of many series is what pairwise() finds for all pairs, but for pairs of order 0, which `rest` tells."""
    monkeypatch.setattr(covariance, "SIDE", side)
    x = uneven(60, 300)
    rows = [(t, i, int(v)) for i, s in enumerate(x) for t, v in enumerate(s) if v] + [(t, 99, int(v)) for t, v in enumerate(x[7]) if v]
    e = spark.createDataFrame(rows, "t long, i long, x long")
    found = pipeline.tests_by_class(e, 1, 4, listed=0).persist()
    n = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    assert n["rest"] == 60 and n["copies"] == n["member"] == 1 and 24 <= n["pair"] < 60 * 59 / 2
    assert found.filter("kind = 'pair' AND p = 0").count() == found.filter("kind = 'rest' AND (src IS NOT NULL OR p != 0 OR f != 0 OR p_edge != 0)").count() == 0
    want = {(r.src, r.dst): r for r in pipeline.expanded(pipeline.tests_by_class(e, 1, 4)).collect()}
    got = {(r.src, r.dst): r for r in pipeline.expanded(found).collect()}
    assert set(got) == set(want) and len(got) == 61 * 60 and all(same(got[k], want[k]) for k in want)
    assert got[1, 0].p_edge > 0.99 and got[1, 0].p > 0


def test_series_of_few_bytes_are_whole_again(spark):
    steps = spark.createDataFrame([("a", -5, [-5, 0, 60], [3, -(2**40), 7]), ("b", -5, [1], [1])], "i string, lo long, at array<long>, xs array<long>")
    t = 70
    classes = steps.select("i", F.lit(1).alias("copies"), F.lit(0.25).alias("m"), F.lit(3.0).alias("d"), "at", "xs")
    rows = panel.packed(classes, -5, 64, 4).orderBy("i").collect()
    z = panel.unpacked([bytes(r.xs) for r in rows], t, 4)
    want = np.zeros((2, t))
    want[0, [0, 5, 65]], want[1, 6] = [3, -(2**40), 7], 1
    assert (z == (want - 0.25) / 3).all() and z.shape == (2, t)
