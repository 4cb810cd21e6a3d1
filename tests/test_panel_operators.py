import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import autoregression as ar
from causeway.operators import covariance, granger, graph, metrics, panel, refit, simulate
from causeway.plans import experiments, pipeline
from causeway.sources import readers, sinks
from causeway.streaming import live


@pytest.fixture(scope="module")
def system(spark):
    x, b, sv2 = simulate.simulate("scg", 7, 600, 2, 0, 5)
    x = x - x.mean(0)
    s = spark.createDataFrame([(i, x[:, i].tolist()) for i in range(7)], "i long, xs array<double>").persist()
    return x, b, s


def test_tiled_covariance_equals_arrays(spark, system):
    x, _, s = system
    r = ar.covariances(x, 3)
    got = {(q.tau, q.i, q.j): q.r for q in covariance.tiled_autocovariance(s, 7, 3, 3).collect()}
    assert len(got) == 4 * 49 and all(abs(r[k] - v) < 1e-9 for k, v in got.items())
    joined = {(q.tau, q.i, q.j): q.r for q in covariance.autocovariance(panel.to_panel(s), 3).collect()}
    assert all(abs(joined[k] - v) < 1e-9 for k, v in got.items())


def test_tiles_do_not_change_pairs(system):
    _, _, s = system
    key = lambda d: sorted((r.src, r.dst, round(r.xi, 9), round(r.xi_pair, 9), r.p) for r in d.collect())
    a, b = key(covariance.pairwise(s, 7, 4, 2)), key(covariance.pairwise(s, 7, 4, 100))
    assert a == b and len(a) == 42


def test_pipeline_equals_array_kernel(system):
    x, b, s = system
    got = sorted(map(tuple, pipeline.recover(pipeline.tests(s, 7, 600, 4)).collect()))
    assert got == pipeline.pwgc_arrays(x, 4)
    fitted = {r.dst: r for r in refit.estimate(graph.with_loops(s.sparkSession.createDataFrame(got, "src long, dst long"), s.select("i")), s, 2).collect()}
    w, res = pipeline.refit_arrays(x, got, 2)
    for d, r in fitted.items():
        assert r.sv2_hat == pytest.approx(res[:, d].var())
        for src, f in zip(r.srcs, r.b):
            assert np.allclose(f, w[:, d, src])
    assert pipeline.iterated_arrays(x, 2)[0]


def test_thresholds_by_frames_and_arrays(spark):
    from causeway.functions import scg

    for seed in range(4):
        p = np.random.default_rng(seed).random(40) ** 3
        d = spark.createDataFrame([(float(v), k, k) for k, v in enumerate(p)], "p_value double, src long, dst long")
        for compat in (True, False):
            assert granger.bh_threshold(d, 0.3, ["p_value", "src", "dst"], compat).first()[0] == pytest.approx(scg.bh_threshold(p, 0.3, compat=compat))


def test_degenerate_panels(spark):
    d = spark.createDataFrame([(t, i, 0 if i == 1 else t % 3) for t in range(9) for i in (1, 2)], "t long, i long, x long")
    assert {r.i for r in panel.zscore(d).collect()} == {2}
    none = spark.createDataFrame([], "t long, i long, x double")
    assert panel.interpolate(none).count() == 0
    gap = spark.createDataFrame([(0, 1, None), (1, 1, 2.0), (2, 1, None), (3, 1, 6.0), (4, 1, None)], "t long, i long, x double")
    assert [r.x for r in panel.interpolate(gap).orderBy("t").collect()] == [2, 2, 4, 6, 6]
    with pytest.raises(Exception, match="no filter"):
        graph.drop_zero_filters(spark.createDataFrame([(1, 2, None)], "src long, dst long, b array<double>")).collect()
    empty = spark.createDataFrame([], "src long, dst long")
    assert np.isnan(metrics.scores(metrics.confusion(empty, empty, 3)).first().fdr)


def test_rank_deciding_scores(spark):
    d = spark.createDataFrame([(1, 2, 5.0, 0.9), (2, 1, 3.0, 0.8), (1, 3, 2.0, 0.0), (3, 1, 1.0, 0.7)], "src long, dst long, f double, p_edge double")
    assert {(r.src, r.dst) for r in granger.candidates(d).collect()} == {(1, 2)}
    assert granger.candidates(d, drop_bidirectional=True).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/abc.us.txt").write_text("Date,Open,High,Low,Close,Volume,OpenInt\n2020-01-02,1,1,1,2.5,100,0\n")
    (tmp_path / "s/none.us.txt").write_text("")
    assert [tuple(r)[0] for r in readers.stocks(spark, str(tmp_path / "s")).collect()] == ["abc"]
    (tmp_path / "sent.csv").write_text("n,symbol,date,sentiment_signal\n0,ABC,2020-01-02,0.5\n")
    assert readers.sentiment(spark, str(tmp_path / "sent.csv")).first().symbol == "abc"
    (tmp_path / "u.csv").write_text("Symbol,Name,Sector\nABC,A,Energy\n")
    assert readers.universe(spark, str(tmp_path / "u.csv")).first().sector == "Energy"
    (tmp_path / "two.csv").write_text("Ticker,A,,B\nts,close,volume,close\n2020-01-02 09:30:00,1.5,10,2.5\n2020-01-02 09:31:00,,11,2.6\n")
    got = {(r.ticker, r.field, r.value) for r in readers.two_row_header(spark, str(tmp_path / "two.csv")).collect()}
    assert ("A", "volume", 10.0) in got and ("B", "close", 2.6) in got and len(got) == 6
    (tmp_path / "t.txt").write_text("# co2a\n0 FP1 0 1.5\n0 FP1 1 2.5\n0 FP2 0 3.5\n")
    assert readers.trial(spark, str(tmp_path / "t.txt"), ["FP1"]).count() == 2
    (tmp_path / "g.gexf").write_text('<gexf><graph><nodes><node id="a" label="A"/><node id="b" label="B"/></nodes><edges><edge id="0" source="a" target="b"/></edges></graph></gexf>')
    nodes, edges = readers.gexf(spark, str(tmp_path / "g.gexf"))
    assert nodes.count() == 2 and tuple(edges.first()) == ("a", "b")
    assert readers.trading_days(spark, "2020-01-01", "2020-01-07").count() == 5
    x, b, sv2 = simulate.simulate("scg", 3, 20, 1, 0, 1)
    sinks.system(spark, str(tmp_path / "sys"), x, b, sv2, q=0.1)
    assert spark.read.parquet(str(tmp_path / "sys/panel")).count() == 60
    e = spark.createDataFrame([("s1", 1, 2)], "subject string, src long, dst long")
    sinks.adjacency(e, str(tmp_path / "adj"))
    assert readers.adjacency(spark, str(tmp_path / "adj")).count() == 1
    assert r"\textbf{0.50}" in sinks.latex(spark.createDataFrame([(0.5, True)], "v double, best boolean"), ["v"], {"v": "best"})
    sinks.errors(e, str(tmp_path / "log"))
    sinks.errors(e, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert spark.range(1).select(readers.subject_class(F.lit("co2a0001"))).first()[0] == "a"


def test_monte_carlo(spark):
    t = experiments.table(experiments.run(experiments.grid(spark, n=(6,), t=(150,), q=(None,), iterations=3, p=1, p_most=3))).collect()
    assert {r.metric for r in t} == {"mcc", "fdr", "lre"}


def test_streams(spark, tmp_path):
    x, b, _ = simulate.simulate("scg", 3, 40, 2, 0, 2)
    spark.createDataFrame([("s", t, x[t].tolist()) for t in range(40)], "system string, t long, xs array<double>").write.parquet(str(tmp_path / "in"))
    steps = spark.readStream.schema("system string, t long, xs array<double>").parquet(str(tmp_path / "in"))
    q = live.residuals(steps, b, ["0", "1", "2"]).writeStream.format("memory").queryName("res").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = np.array([r.r for r in spark.table("res").orderBy("t").collect()])
    assert np.allclose(got, simulate.Var(b).residuals(x))
    e = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    q = live.windowed_panel(e, "ts", "event_type", "value").writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").count() > 800


def test_diagnostics(spark):
    from causeway.operators import diagnostics

    rng = np.random.default_rng(0)
    walk, noise = rng.normal(size=800).cumsum(), rng.normal(size=800)
    assert diagnostics.adf_statistic(noise, 3)[0] < -8 and diagnostics.adf_statistic(walk, 3)[0] > -3.5
    nu, mu, sigma = diagnostics.student_t_fit(rng.standard_t(3, 5000) * 2 + 1)
    assert 2 < nu < 4.5 and abs(mu - 1) < 0.15 and abs(sigma - 2) < 0.2
    assert np.isnan(diagnostics.student_t_fit(np.ones(9))[0]) and np.isnan(diagnostics.adf_statistic(np.ones(90), 2)[0])


def test_registered_functions(spark):
    from causeway.functions import udfs

    udfs.register(spark)
    r = spark.sql("SELECT chi2_cdf(3.0D, 2.0D) a, f_cdf(1.0D, 2.0D, 10.0D) b, t_cdf(0.0D, 5.0D) c, edge_probability(3.0D, 2.0D) d").first()
    assert r.a == pytest.approx(1 - np.exp(-1.5)) and r.b == pytest.approx(1 - 1.2**-5) and r.c == pytest.approx(0.5) and r.d == r.a


def test_refit_is_alike_by_broadcast_and_by_join(system, monkeypatch):
    _, _, s = system
    edges = graph.complete(s.select("i"))
    key = lambda: {r.dst: (round(r.sv2_hat, 9), r.srcs, np.round(r.b, 9).tolist()) for r in refit.estimate(edges, s, 2, most=300).collect()}
    small = key()
    monkeypatch.setattr(refit, "SHARED_VALUES", 0)
    assert key() == small and len(small) == 7


def test_default_reach_of_weighted_means(spark):
    x = np.random.default_rng(3).normal(size=500)
    d = spark.createDataFrame([(t, 0, float(v)) for t, v in enumerate(x)], "t long, i long, x double")
    got = [r.x for r in panel.ewm_mean(d, 1.5).orderBy("t").collect()]
    w = 0.5 ** (np.arange(500) / 1.5)
    want = [(w[: t + 1] * x[t::-1]).sum() / w[: t + 1].sum() for t in range(500)]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-14)


def test_weighted_mean_query_weighs_the_whole_history(spark):
    from causeway.plans import queries

    sf = "/root/testdata/sf0.001"
    z = queries.z_panel(spark, sf).toPandas().sort_values(["i", "t"])
    z["x"] = z.groupby("i").x.transform(lambda x: x.ewm(halflife=2.5, adjust=True).mean())
    got = queries.QUERIES["ewm_halflife_whole"](spark, sf).toPandas().sort_values(["i", "t"])
    assert len(got) == len(z) and np.allclose(got.x.to_numpy(), z.x.to_numpy(), rtol=0, atol=1.01e-6)


def test_split_of_a_hot_label(spark):
    d = spark.createDataFrame([(k, None if k % 50 == 0 else "a" if k % 7 else "b", k) for k in range(2000)], "key long, label string, _n long")
    rows = metrics.stratified_split(d, "label", "key").collect()
    assert sorted(r.key for r in rows) == list(range(2000)) and rows[0].asDict().keys() == {"key", "label", "_n", "is_test"}
    for label in (None, "a", "b"):
        own = [r for r in rows if r.label == label]
        assert sum(r.is_test for r in own) == -(-len(own) // 5)


def test_tiles_rank_names_alone(system):
    _, _, s = system
    assert sorted((r.k, r.i) for r in covariance.numbered(s).collect()) == [(k, k) for k in range(7)]


def test_dependent_thresholds_and_harmonic_numbers(spark):
    from causeway.functions import scg

    d = spark.createDataFrame([(m,) for m in (1, 2, 31, 32, 33, 1000)], "m long").select("m", granger.harmonic(F.col("m")).alias("h"))
    assert all(r.h == pytest.approx(sum(1 / k for k in range(1, r.m + 1)), rel=1e-13) for r in d.collect())
    for p in ([0.9, 0.95, 0.99], [1e-9, 1e-8, 1e-7], [0.9, 1e-4, 0.03], [1.0, 1.0, 1.0], list(np.random.default_rng(1).random(70) ** 4)):
        d = spark.createDataFrame([(float(v), k, k) for k, v in enumerate(p)], "p_value double, src long, dst long")
        assert granger.bh_threshold(d, 0.3, ["p_value", "src", "dst"], independent=False).first()[0] == pytest.approx(scg.bh_threshold(p, 0.3, independent=False))


def test_no_test_no_edge(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    assert pipeline.pwgc_arrays(np.ones((60, 3)) + 1e-3 * x, 1, threshold_only=True) == []
    t = spark.createDataFrame([(0, 1, 0.0), (1, 0, 0.0)], "src long, dst long, p_edge double")
    assert granger.threshold_edges(t, spark.createDataFrame([(1.0,)], "threshold double")).count() == 0
    with pytest.raises(ValueError):
        pipeline.graphs_by_group(t.selectExpr("src AS k", "dst AS i", "array(1D) AS xs"), ["k"], 1, "other")


def test_tickers_are_read_by_name(spark, tmp_path):
    (tmp_path / "abc.us.txt").write_text("Date,Close,Volume\n2020-01-02,2.5,100\nbad,1,2\n")
    (tmp_path / "xyz.us.txt").write_text("volume,DATE,Open,close\r\n7,2020-01-03,1,9.5\r\n")
    (tmp_path / "none.us.txt").write_text("")
    (tmp_path / "less.us.txt").write_text("Date,Close\n2020-01-02,4\n")
    got = sorted((r.symbol, str(r.date), r.close, r.volume) for r in readers.stocks(spark, str(tmp_path)).collect())
    assert got == [("abc", "2020-01-02", 2.5, 100.0), ("less", "2020-01-02", 4.0, None), ("xyz", "2020-01-03", 9.5, 7.0)]
    only = spark.createDataFrame([("XYZ",)], "symbol string")
    assert [r.symbol for r in readers.stocks(spark, str(tmp_path), only).collect()] == ["xyz"]


def test_stored_arrays_are_read(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[0, 1.0], [0.5, 0]]))
    np.save(tmp_path / "flat.npy", np.arange(3))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    assert sorted(tuple(r) for r in readers.adjacency_arrays(spark, str(tmp_path)).collect()) == [("a.npy", 0, 1, 1.0), ("a.npy", 1, 0, 0.5)]


def test_joint_fit_and_datasets(system):
    _, b, s = system
    found = {(r.src, r.dst): r.b for r in pipeline.joint_alasso(s, 2).collect()}
    big = {(int(k), int(d)) for d, k in np.argwhere((np.abs(b) > 0.3).any(0))}
    assert big <= set(found) and len(found) < 30
    rng = np.random.default_rng(0)
    for kind in ("er", "gn"):
        d = simulate.drawn_dataset(kind, 8, 300, 2, 0.3, rng)
        assert d["x"].shape == (301, 8) and not d["x"][0].any() and simulate.Var(d["b"]).radius() < 0.99
        assert {(int(a), int(c)) for a, c in np.argwhere(d["g"])} >= set(simulate.Var(d["b"]).graph())
    assert simulate.random_system(4, 2, rng, adjacency=np.eye(4)).any(0).sum() == 4
    assert set(simulate.iid_bernoulli(0.5, 50, rng)) == {0, 1} and abs(simulate.iid_normal(9000, rng, 2.0, 4.0).std() - 2) < 0.1
    x, y = simulate.demo(4000), simulate.demo(4000, coupled=True)
    late = lambda z: np.corrcoef(z[150:, 0], z[:-150, 2])[0, 1]
    assert abs(late(x)) < 0.3 < late(y)


def test_studies(spark):
    g = experiments.over_nodes(spark, n=(5, 6), t=80, iterations=1, p=1, p_most=2)
    assert g.count() == 6 and {r.n for r in g.collect()} == {5, 6}
    assert experiments.over_density(spark, q=(0.1, 0.2), n=5, t=60, iterations=2).count() == 4
    got = experiments.tracked(experiments.run(experiments.short_series(spark, t=(60, 90), n=4, iterations=2, p=1, p_most=2), ("pwgc",), 50), "t").collect()
    assert {(r.t, r.metric) for r in got} == {(t, m) for t in (60, 90) for m in ("mcc", "fdr", "lre")}


def test_tile_sizes(spark):
    s = spark.createDataFrame([(k, [0.0] * 3000) for k in range(8)], "i long, xs array<double>")
    assert 1 <= covariance.tile_size(s, 8) <= 16 and covariance.tile_size(s, 10**6) == covariance.MOST
