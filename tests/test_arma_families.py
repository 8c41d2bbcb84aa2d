"""ARMA likelihoods and orders, families of laws, weighted portmanteau and incomplete gamma, against direct computations."""

import math

import numpy as np
import pytest

from quantloom.functions import arma, families
from quantloom.functions import kernels as K
from quantloom.functions import laws as L


def arma_series(phi, theta, n, seed=1):
    rng = np.random.default_rng(seed)
    e, x = rng.standard_normal(n + 300), np.zeros(n + 300)
    for t in range(5, n + 300):
        x[t] = e[t] + sum(p * x[t - 1 - k] for k, p in enumerate(phi)) + sum(q * e[t - 1 - k] for k, q in enumerate(theta))
    return x[300:]


def test_likelihood_is_that_of_the_whole_covariance():
    x = arma_series([0.6, -0.3], [0.5], 300)
    phi, theta = np.array([[0.6, -0.3]]), np.array([[0.5, 0.0]])
    psi = [1.0]
    for k in range(1, 3000):
        psi.append((theta[0, k - 1] if k <= 2 else 0.0) + sum(phi[0, j] * psi[k - 1 - j] for j in range(min(2, k))))
    psi = np.array(psi)
    gamma = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(300)])
    c = gamma[np.abs(np.subtract.outer(np.arange(300), np.arange(300)))]
    s = x @ np.linalg.solve(c, x) / 300
    want = -150 * (math.log(2 * math.pi) + 1 + math.log(s)) - 0.5 * np.linalg.slogdet(c)[1]
    got, var = arma.loglik(x, phi, theta, np.zeros(1))
    assert got[0] == pytest.approx(want, abs=1e-6) and var[0] == pytest.approx(s, rel=1e-8)


@pytest.mark.parametrize("phi, theta", [([0.7], []), ([], [0.6]), ([0.5, -0.4], []), ([], [])])
def test_orders_are_found(phi, theta):
    x = 3 + 2 * arma_series(phi, theta, 1500, seed=4)
    ranked = arma.best(x, most=3)
    f = next(r for r in ranked if (r["p"], r["q"]) == (len(phi), len(theta)))
    assert f["aic"] - ranked[0]["aic"] < 4  # AIC may take a parameter more, but the true order is near the first
    assert f["ar"] == pytest.approx(phi, abs=0.08) and f["ma"] == pytest.approx(theta, abs=0.08) and f["variance"] == pytest.approx(4, rel=0.1)
    lesser = [r for r in ranked if r["p"] < len(phi) or (r["q"] < len(theta) and r["p"] < 3)]
    assert not phi or min(r["aic"] for r in lesser if r["p"] == 0 and r["q"] == 0) > f["aic"] + 20


DRAWN = {"NO": (), "TF": (4.0,), "SST": (0.6, 6.0), "JSU": (-1.0, 1.5), "GED": (1.0,), "LO": ()}


@pytest.mark.parametrize("name", DRAWN)
def test_the_true_family_is_among_the_first(name):
    x = 0.3 + 1.5 * families.KINDS[name].draw(np.random.default_rng(6), 6000, *DRAWN[name])
    fits = {k: families.fit(x, k) for k in families.KINDS}
    f = fits[name]
    least = min(v["aic"] for v in fits.values())
    assert f["aic"] - least < 2.5 and f["sigma"] == pytest.approx(1.5, rel=0.1)
    assert f["shape"] == pytest.approx(DRAWN[name], rel=0.25) and families.ks_drawn(x, f)[1] > 0.01
    if name in ("SST", "JSU"):
        assert fits["NO"]["aic"] > least + 100 and families.ks_drawn(x, fits["NO"])[1] < 0.05


def test_families_are_densities():
    y = np.linspace(-10, 10, 200_001)
    x = np.sinh(y) / 2
    for name, kind in families.KINDS.items():
        f = np.exp(kind.logpdf(x, *DRAWN.get(name, (0.8, 5.0)))) * np.cosh(y) / 2 * (y[1] - y[0])
        assert f.sum() == pytest.approx(1, abs=1e-3), name


def test_incomplete_gamma():
    for df in (2, 4, 10, 11):
        for x in (0.1, 3.0, 9.0, 40.0):
            assert K.gamma_tail(x / 2, df / 2) == pytest.approx(K.chi2_tail(x, df), abs=1e-12)


def test_weighted_portmanteau_has_its_size_and_its_weights():
    rng = np.random.default_rng(2)
    ps = [K.weighted_ljung_box(rng.standard_normal(400), 10)[1] for _ in range(600)]
    assert 0.03 < np.mean(np.array(ps) < 0.05) < 0.075 and 0.45 < np.mean(ps) < 0.55
    x = rng.standard_normal(200)
    c = x - x.mean()
    rho = [c[k:] @ c[:-k] / (c @ c) for k in range(1, 11)]
    assert K.weighted_ljung_box(x, 10)[0] == pytest.approx(200 * 202 * sum((11 - k) / 10 * r * r / (200 - k) for k, r in enumerate(rho, 1)))
    assert K.weighted_tail(5.0, 10, 4) is None and K.weighted_ljung_box(x, 10, 4)[1] == pytest.approx(K.gamma_tail(K.ljung_box(x, 10) / 2, 3))
    assert L.norm(0.0) == pytest.approx(-0.5 * math.log(2 * math.pi))
