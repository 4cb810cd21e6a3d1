import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.functions import autoregression as ar
from causeway.functions import scg, special
from causeway.operators import simulate
from causeway.plans import pipeline


def test_special_functions_have_their_closed_forms():
    x = np.linspace(0.01, 60, 300)
    assert np.allclose(special.chi2_cdf(x, 2), 1 - np.exp(-x / 2), atol=1e-13)
    assert np.allclose(special.chi2_cdf(x, 4), 1 - np.exp(-x / 2) * (1 + x / 2), atol=1e-13)
    for d in (3, 10, 500):
        assert np.allclose(special.f_cdf(x, 2, d), 1 - (1 + 2 * x / d) ** (-d / 2), atol=1e-11)
    t = np.linspace(-9, 9, 101)
    assert np.allclose(special.t_cdf(t, 1), 0.5 + np.arctan(t) / math.pi, atol=1e-11)
    assert np.allclose(special.t_cdf(t, 2), 0.5 + t / (2 * np.sqrt(2 + t * t)), atol=1e-11)
    assert special.edge_probability([5.0, -1.0, np.nan, 3.0], [2, 2, 2, 0]).tolist()[1:] == [0, 0, 0]


def test_levinson_of_a_first_order_process():
    for phi in (-0.9, 0.3, 0.8):
        eps, b = ar.levinson(phi ** np.arange(6)[None, :])
        assert np.allclose(eps[0, 1:], 1 - phi**2)
        assert np.allclose(b[0], [phi, 0, 0, 0, 0], atol=1e-12)


def test_whittle_of_a_known_system():
    v = simulate.Var(np.array([[[0.5, 0.2], [0.0, 0.4]]]))
    noise = np.array([[1.0, 0.3], [0.3, 2.0]])
    err, a = ar.whittle(v.acf(noise, 4)[None])
    assert np.allclose(err[0, 1:], noise, atol=1e-9)
    assert np.allclose(a[0, 0], v.b[0], atol=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6))
def test_recursions_agree_with_direct_solutions(seed, p):
    x = np.random.default_rng(seed).normal(size=(80, 2)).cumsum(0) * 0.1 + np.random.default_rng(seed + 1).normal(size=(80, 2))
    assert simulate.check_recursions(x, p) < 1e-7
    eps, _ = ar.levinson(ar.covariances(x[:, :1], p)[:, 0, 0][None])
    assert (np.diff(eps[0]) <= 1e-12).all()
    r = ar.covariances(x, p)
    one, two = ar.bivariate(r[None], 80), ar.bivariate(r[:, ::-1, ::-1][None], 80)
    assert np.allclose([one[0], one[1]], [two[1], two[0]]) and one[2] == two[2]


def test_least_squares_chain_survives_singular_regressors():
    x = np.random.default_rng(0).normal(size=(50, 1))
    b = ar.least_squares(np.hstack([x, x, 0 * x]), x[:, 0])
    assert np.isfinite(b).all() and np.allclose(np.hstack([x, x, 0 * x]) @ b, x[:, 0], atol=0.2)


@pytest.mark.parametrize("method", ["lstsqr", "lasso", "alasso", "glasso"])
def test_penalised_fits_find_the_support(method):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    true = np.zeros(12)
    true[:3] = [1.0, -2.0, 0.5]
    b = ar.fit(method, x, x @ true + rng.normal(size=600) * 0.3, 3)
    assert np.abs(b - true).max() < 0.15
    if method in ("lasso", "alasso"):
        assert (np.abs(b[3:]) < 0.05).all() and (b[:3] != 0).all()
    with pytest.raises(ValueError):
        ar.fit("ls", x, x[:, 0], 3)


def test_threshold_patterns():
    line = lambda flags: np.array([0.05 * (k + 1) / len(flags) * (0.5 if f else 1.0) + (0 if f else 1e-3 * (k + 1)) for k, f in enumerate(flags)])
    for flags, place in (("TTF", 1), ("FFT", 1), ("FTTF", 0), ("FFF", 0), ("TTT", 0)):
        p = np.sort(line([c == "T" for c in flags]))
        below = p < 0.05 * np.arange(1, len(p) + 1) / len(p)
        if [*below] == [c == "T" for c in flags]:
            assert scg.bh_threshold(p, 0.05) == p[place]
    with pytest.raises(ValueError):
        scg.bh_threshold([0.5], 0.05)
    assert scg.bh_threshold([0.001, 0.02, 0.9], 0.05, compat=False) == 0.02


EXAMPLE = [(1, 3), (2, 4), (3, 4), (3, 5), (4, 6)]


def test_oracle_recovers_the_example():
    assert scg.oracle(EXAMPLE, [1, 2, 3, 4, 5, 6]) == EXAMPLE


def test_diamond_is_not_strongly_causal():
    assert scg.is_strongly_causal(EXAMPLE)
    assert not scg.is_strongly_causal([("a", "i"), ("a", "d"), ("j", "d"), ("i", "j")])
    with pytest.raises(ValueError):
        scg.path_counts([(1, 2), (2, 1)])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_recovered_graphs_are_strongly_causal(seed):
    rng = np.random.default_rng(seed)
    n = 7
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
    score = {e: float(s) for e, s in zip(pairs, rng.exponential(size=len(pairs)))}
    sure = {e: float(s) * (s > 0.4) for e, s in zip(pairs, rng.random(len(pairs)))}
    edges = scg.recover(list(range(n)), score, sure)
    assert scg.is_strongly_causal(edges)
    assert not {(d, s) for s, d in edges} & set(edges)


def test_trees_and_recovery_from_data():
    hits = truth = found = 0
    for seed in range(6):
        x, b, _ = simulate.simulate("scg", 8, 1500, 2, 0, seed)
        true = {(int(s), int(d)) for d, s in np.argwhere((b != 0).any(0)) if s != d}
        assert len(true) == 7 and scg.is_strongly_causal(sorted(true))
        got = set(pipeline.pwgc_arrays(x, 4))
        hits, truth, found = hits + len(got & true), truth + len(true), found + len(got)
    assert hits / truth > 0.55 and hits / found > 0.8


def test_systems():
    v = simulate.Var(np.array([[[0.5]], [[0.2]]]))
    x = v.drive(np.ones((5, 1)))
    assert np.allclose(x[:3, 0], [1, 1.5, 1.95])
    v.reset()
    assert np.allclose(v.residuals(x), 1)
    assert v.stable() and v.graph() == [(0, 0)]
    assert simulate.Var(np.array([[[2.0]]])).stabilised(0.5).radius() == pytest.approx(0.5)
    a = simulate.elementary_sums([np.diag([2.0]), np.diag([3.0])])
    assert [float(m[0, 0]) for m in a] == [5, 6]
    assert simulate.Var(simulate.growing_network(6, 2, np.random.default_rng(0))).n == 6
    assert v.power_transfer(np.array([0.0]))[0, 0, 0] == pytest.approx((1 / 0.3) ** 2)


def test_lasso_path_is_optimal():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(60 if seed % 2 else 15, 20)) @ (np.eye(20) + 0.4 * rng.normal(size=(20, 20)))
        if seed == 4:
            x[:, 3] = x[:, 7]
        y = x[:, :3] @ [1.0, -2.0, 0.5] + rng.normal(size=len(x))
        g, c = x.T @ x / len(x), x.T @ y / len(x)
        last = np.inf
        for penalty, b in ar.lasso_path(g, c, len(x) - 1):
            r = c - g @ b
            assert penalty <= last + 1e-12 and np.abs(r).max() <= penalty + 1e-6
            assert np.allclose(r[b != 0], penalty * np.sign(b[b != 0]), atol=1e-6)
            last = penalty
        assert last < 0.2 * np.abs(c).max()
    assert not list(ar.lasso_path(np.zeros((2, 2)), np.zeros(2), 5))
