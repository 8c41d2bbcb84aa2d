"""Pair copulas and vines against their definitions, and against laws they were drawn from."""

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.functions import vine as V

CASES = [("gaussian", 0, (0.6,)), ("gaussian", 0, (-0.4,)), ("t", 0, (0.5, 4.0)), ("frank", 0, (5.0,)), ("frank", 0, (-6.0,))]
CASES += [(f, r, (a,)) for f, a in (("clayton", 2.0), ("gumbel", 2.0), ("joe", 2.5)) for r in (0, 90, 180, 270)]


def test_kendall_is_the_count_of_pairs():
    rng = np.random.default_rng(1)
    for n, top in ((2, 9), (40, 6), (60, 10**6), (33, 2)):
        x, y = rng.integers(0, top, n), rng.integers(0, top, n)
        sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
        want = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()) if (sx**2).sum() * (sy**2).sum() else 0.0
        assert V.kendall(x, y) == pytest.approx(want)


@pytest.mark.parametrize("family, rotation, theta", CASES)
def test_pairs_are_what_they_say(family, rotation, theta):
    p = V.Pair(family, rotation, theta)
    g = (np.arange(400) + 0.5) / 400
    u, v = np.meshgrid(g, g, indexing="ij")
    c = np.exp(p.logpdf(u.ravel(), v.ravel())).reshape(400, 400)
    assert c.mean() == pytest.approx(1, abs=0.03)  # a density
    x, y = np.array([0.1, 0.3, 0.5, 0.77, 0.93]), np.array([0.8, 0.2, 0.55, 0.4, 0.9])
    for h, inverse, own in ((p.h, p.inverse, True), (p.h_other, p.inverse_other, False)):
        q = h(x, y)
        assert ((q > 0) & (q < 1)).all()
        assert np.allclose(inverse(q, y if own else x), x if own else y, atol=2e-6)
    # h is the integral of the density over the other variable's line
    for k in range(5):
        line = (np.arange(20_000) + 0.5) / 20_000
        d = np.exp(p.logpdf(line, np.full(20_000, y[k])))
        assert d[line <= x[k]].mean() * (line <= x[k]).mean() == pytest.approx(p.h(x[k : k + 1], y[k : k + 1])[0], abs=4e-3)
        d = np.exp(p.logpdf(np.full(20_000, x[k]), line))
        assert d[line <= y[k]].mean() * (line <= y[k]).mean() == pytest.approx(p.h_other(x[k : k + 1], y[k : k + 1])[0], abs=4e-3)


@pytest.mark.parametrize("family, rotation, theta", CASES)
def test_the_true_pair_is_found(family, rotation, theta):
    p, rng = V.Pair(family, rotation, theta), np.random.default_rng(5)
    v = rng.random(4000)
    u = p.inverse(rng.random(4000), v)
    got = V.fit_pair(u, v)
    assert (got.family, got.rotation) == (family, rotation)
    assert got.theta[0] == pytest.approx(theta[0], rel=0.12)
    assert got.loglik == pytest.approx(float(got.logpdf(u, v).sum())) and got.loglik > float(p.logpdf(u, v).sum()) - 1


def true_vine():
    """A vine of four variables that is neither a star nor a path in all its trees."""
    e = lambda tree, a, b, given, *pair: V.Edge(tree, a, b, frozenset(given), V.Pair(*pair), 0.0)
    return V.Vine(4, [
        e(1, 0, 1, (), "gumbel", 0, (3.0,)), e(1, 1, 2, (), "clayton", 90, (4.0,)), e(1, 1, 3, (), "t", 0, (0.85, 4.0)),
        e(2, 0, 2, (1,), "frank", 0, (2.0,)), e(2, 2, 3, (1,), "clayton", 180, (0.5,)), e(3, 0, 3, (1, 2), "gaussian", 0, (0.2,)),
    ])


def test_vines_are_drawn_and_found_again():
    true = true_vine()
    u = true.sample(4000, np.random.default_rng(3))
    assert all(K.ks_p(K.ks_against(u[:, k], lambda x: x), len(u)) > 0.01 for k in range(4))
    got = V.fit(u)
    assert [(e.tree, e.a, e.b, sorted(e.given)) for e in got.edges if e.tree == 1] == [(1, 0, 1, []), (1, 1, 2, []), (1, 1, 3, [])]
    assert {(e.a, e.b, e.pair.family, e.pair.rotation) for e in got.edges if e.tree == 1} == {(0, 1, "gumbel", 0), (1, 2, "clayton", 90), (1, 3, "t", 0)}
    ll = float(true.logpdf(u).sum())
    assert got.loglik == pytest.approx(float(got.logpdf(u).sum())) and abs(got.loglik - ll) < 0.02 * abs(ll)
    again = got.sample(4000, np.random.default_rng(4))
    for a in range(4):
        for b in range(a):
            assert V.kendall(again[:, a], again[:, b]) == pytest.approx(V.kendall(u[:, a], u[:, b]), abs=0.04)


def test_of_a_normal_law_the_vine_has_its_likelihood():
    rng = np.random.default_rng(8)
    r = np.array([[1, 0.5, 0.3, 0.1], [0.5, 1, 0.6, 0.2], [0.3, 0.6, 1, 0.4], [0.1, 0.2, 0.4, 1]])
    x = rng.multivariate_normal(np.zeros(4), r, 3000)
    got = V.fit(K.pseudo(x), ("gaussian",))
    z = K.norm_ppf(K.pseudo(x))
    c = np.corrcoef(z, rowvar=False)
    want = -0.5 * len(x) * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->", z, np.linalg.inv(c) - np.eye(4), z)
    assert got.loglik == pytest.approx(want, rel=0.01) and got.parameters == 6


def test_a_vine_packed_and_unpacked_is_the_same():
    v = true_vine()
    w = V.unpacked(4, V.packed(v))
    assert w.edges == v.edges


def test_few_variables_and_constant_columns():
    u = np.random.default_rng(1).random((50, 2))
    assert len(V.fit(u).edges) == 1 and V.fit(u).sample(5, np.random.default_rng(1)).shape == (5, 2)
    assert V.kendall(np.ones(9), np.arange(9)) == 0.0 and np.isfinite(V.fit(np.column_stack([u, np.full(50, 0.5)])).loglik)
