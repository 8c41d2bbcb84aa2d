"""Laws, and GARCH models of four kinds, against their definitions and against series that were drawn from them."""

import math

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.functions import laws as L
from quantloom.functions import volatility as G

POINTS = {"norm": [()], "std": [(3.0,), (8.0,)], "sstd": [(0.7, 5.0), (1.4, 9.0)], "ged": [(1.0,), (1.7,)], "sged": [(0.8, 1.3), (1.3, 1.8)], "nig": [(0.3, 1.0), (-0.5, 0.4)], "jsu": [(-0.7, 1.6), (0.5, 2.5)]}
CASES = [(k, p) for k, ps in POINTS.items() for p in ps]


@pytest.mark.parametrize("name, p", CASES)
def test_laws_have_mass_1_mean_0_and_variance_1(name, p):
    y = np.linspace(-11, 11, 400_001)
    x = np.sinh(y) / 5
    f = np.exp(L.LAWS[name].logpdf(x, *p)) * np.cosh(y) / 5 * (y[1] - y[0])
    assert f.sum() == pytest.approx(1, abs=1e-5) and (x * f).sum() == pytest.approx(0, abs=1e-4) and (x * x * f).sum() == pytest.approx(1, abs=2e-2 if p == (3.0,) else 2e-3)
    u = np.array([0.001, 0.02, 0.3, 0.5, 0.9, 0.999])
    assert np.allclose(L.cdf(name, L.ppf(name, u, *p), *p), u, atol=1e-6)
    assert L.mean_abs(name, p) == pytest.approx((np.abs(x) * f).sum(), abs=1e-3)
    assert G._abs(name, [np.array([v]) for v in p]) == pytest.approx(L.mean_abs(name, p), abs=2e-3)


@pytest.mark.parametrize("name, p", CASES)
def test_maps_of_parameters_go_back(name, p):
    law = L.LAWS[name]
    assert np.allclose(law.values([back(v) for v, (_, back) in zip(p, law.maps)]), p)


def drawn(model, law, p, n=4000, seed=3, mu=0.05, omega=0.05, alpha=0.08, beta=0.88, gamma=0.0, delta=2.0, ma=0.0, ar=0.0):
    rng = np.random.default_rng(seed)
    z = L.ppf(law, rng.random(n + 200), *p)
    m, s, r, e0 = L.mean_abs(law, p), 1.0, np.empty(n + 200), 0.0
    before = mu
    for t in range(n + 200):
        e = math.sqrt(s) * z[t]
        r[t] = mu + ar * (before - mu) + ma * e0 + e
        before, e0 = r[t], e
        s = G.variance_step(model, s, e, omega, alpha, beta, gamma, delta, m)
    return r[200:]


def test_log_k1():
    t = np.linspace(0, 12, 20_001)
    for x in (0.05, 0.5, 1.99, 2.01, 7.0, 40.0):
        want = math.log(np.trapezoid(np.exp(-x * (np.cosh(t) - 1)) * np.cosh(t), t)) - x
        assert float(L.log_k1(np.array(x))) == pytest.approx(want, abs=2e-6)


def test_variance_in_lanes_is_the_recursion_step_by_step():
    rng = np.random.default_rng(1)
    e = rng.standard_normal((60, 3))
    for model in G.MODELS:
        omega, alpha, beta, gamma, delta = np.array([0.05, 0.1, 0.02]), np.array([0.05, 0.1, 0.08]), np.array([0.9, 0.8, 0.7]), np.array([0.05, 0.1, 0.2]), np.array([2.0, 1.5, 1.2])
        s = G.variance(model, e, omega, alpha, beta, gamma, delta, 0.8)
        for j in range(3):
            x = s[0, j]
            for t in range(60):
                x = G.variance_step(model, x, e[t, j], omega[j], alpha[j], beta[j], gamma[j], delta[j], 0.8)
                assert s[t + 1, j] == pytest.approx(x, rel=1e-9)
    assert np.allclose(G.variance("garch", e[:, :1], 0.05, 0.1, 0.85, 0.0, 2.0, 0.0)[:, 0], K.garch_variance(e[:, 0], 0.05, 0.1, 0.85, K.backcast(e[:, 0])))


def test_garch_fit_agrees_with_the_other_one():
    r = drawn("garch", "std", (6.0,), 2000)
    (a,), b = G.fit(r, "garch", ["std"]), K.garch_fit(r)
    assert a["loglik"] >= b["loglik"] - 0.05 and abs(a["loglik"] - b["loglik"]) < 1 and a["alpha"] == pytest.approx(b["alpha"], abs=0.02)


@pytest.mark.parametrize("model, own", [("gjr", {"alpha": 0.03, "gamma": 0.1}), ("egarch", {"omega": 0.0, "alpha": -0.1, "gamma": 0.2, "beta": 0.95}), ("aparch", {"gamma": 0.5, "delta": 1.2, "alpha": 0.1})])
def test_parameters_of_drawn_series_are_found(model, own):
    r = drawn(model, "sstd", (0.8, 7.0), **own)
    fits = {f["law"]: f for f in G.fit(r, model, ["norm", "std", "sstd"])}
    f = fits["sstd"]
    assert f["loglik"] > fits["std"]["loglik"] > fits["norm"]["loglik"]
    assert f["law_p"][0] == pytest.approx(0.8, abs=0.08) and 4.5 < f["law_p"][1] < 12 and f["beta"] == pytest.approx(own.get("beta", 0.88), abs=0.06)
    assert f["alpha"] == pytest.approx(own["alpha"], abs=0.05) and f["gamma"] == pytest.approx(own["gamma"], abs=0.25 if model == "aparch" else 0.07)
    assert min(G.gof(f)) > 1e-3 and 0.8 < G.persistence(f) < 1 and G.long_run(f) > 0


def test_no_start_finds_a_greater_likelihood():
    r = drawn("aparch", "jsu", (-0.5, 2.0), 1500, gamma=0.4, delta=1.5)
    for model in G.MODELS:
        (f,) = G.fit(r, model, ["jsu"])
        x = np.array(G.start(model, "jsu", (0, 0), r))
        rng = np.random.default_rng(2)
        again, best = G.maximise(lambda p, _: G.loglik(model, "jsu", (0, 0), r, p)[0], x + 0.3 * rng.standard_normal((6, len(x))))
        assert best.max() < f["loglik"] + 1.0, model


def test_means_with_ar_and_ma_parts():
    r = drawn("garch", "std", (8.0,), 3000, ar=0.5, ma=0.3)
    (f,) = G.fit(r, "garch", ["std"], (1, 1))
    assert f["ar"][0] == pytest.approx(0.5, abs=0.08) and f["ma"][0] == pytest.approx(0.3, abs=0.08) and f["k"] == 7
    (plain,) = G.fit(r, "garch", ["std"])
    assert f["loglik"] > plain["loglik"] + 50
