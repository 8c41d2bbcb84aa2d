import math

import numpy as np
import pytest

from quantloom.functions import kernels as K


def test_t_distribution():
    assert float(K.t_ppf(0.975, 10)) == pytest.approx(2.2281388520, abs=1e-5)
    assert float(K.t_cdf(2.2281388520, 10)) == pytest.approx(0.975, abs=1e-6)
    assert float(K.t_ppf(0.01, 2.5)) == pytest.approx(-float(K.t_ppf(0.99, 2.5)))


def test_gpd_fit_finds_shape_and_scale():
    rng = np.random.default_rng(1)
    u = rng.random(20_000)
    for xi, sigma in ((0.3, 2.0), (-0.2, 1.0)):
        got = K.gpd_fit(sigma / xi * (u**-xi - 1))
        assert got == pytest.approx((xi, sigma), abs=0.05)
    assert K.gpd_fit(-np.log(u))[0] == pytest.approx(0, abs=0.03)


def test_t_fit_finds_degrees_of_freedom():
    x = np.random.default_rng(2).standard_t(5, 20_000) * 0.02 + 0.001
    nu, m, s = K.t_fit(x)
    assert nu == pytest.approx(5, rel=0.15) and s == pytest.approx(0.02, rel=0.05) and m == pytest.approx(0.001, abs=1e-3)


def test_garch_fit_beats_the_truth_in_sample():
    rng = np.random.default_rng(4)
    s, e = 1.0, []
    for _ in range(3000):
        x = math.sqrt(s) * rng.standard_t(8) * math.sqrt(6 / 8)
        e.append(x)
        s = 0.05 + 0.1 * x * x + 0.85 * s
    f = K.garch_fit(np.array(e))
    assert f["alpha"] == pytest.approx(0.1, abs=0.05) and f["beta"] == pytest.approx(0.85, abs=0.1)
    assert K.garch_fit(np.array(e), leverage=True)["loglik"] >= f["loglik"] - 1


def test_t_copula_fit_finds_correlation_and_nu():
    r = np.array([[1, 0.6], [0.6, 1]])
    u = K.t_copula_sample(r, 4, 4000, np.random.default_rng(5))
    got, nu, _ = K.t_copula_fit(K.pseudo(u))
    assert got[0, 1] == pytest.approx(0.6, abs=0.05) and 3 <= nu <= 6


def test_pseudo_observations_of_ties():
    assert K.pseudo(np.array([[1.0], [1.0], [3.0]]))[:, 0].tolist() == pytest.approx([0.375, 0.375, 0.75])


def test_pot_of_a_pareto_tail():
    x = np.random.default_rng(6).pareto(3, 5000)
    p = K.pot(x, 0.9, 0.99)
    assert p["fallback"] == "none" and p["var"] == pytest.approx(0.01 ** (-1 / 3) - 1, rel=0.1) and p["es"] >= p["var"]
    with pytest.raises(ValueError):
        K.pot(x, 0.99, 0.9)


def test_ks_of_the_right_and_a_wrong_law():
    x = np.random.default_rng(8).standard_normal(500)
    assert K.ks_p(K.ks_against(x, K.norm_cdf), 500) > 0.01 > K.ks_p(K.ks_against(x + 0.5, K.norm_cdf), 500)


def test_variances_follow_the_recursion():
    e = np.random.default_rng(2).standard_t(5, 333)
    want = [1.3]
    for x in e:
        want.append(max(0.05 + (0.1 + 0.02 * (x < 0)) * x * x + 0.85 * want[-1], 1e-12))
    for n in (0, 1, 63, 64, 65, 333):
        assert K.garch_variance(e[:n], 0.05, 0.1, 0.85, 1.3, 0.02) == pytest.approx(want[: n + 1])


def test_t_copula_fit_is_the_profile_of_each_nu():
    """Scores, correlation and likelihood of each nu, written out."""
    r = np.array([[1, 0.6, 0.2], [0.6, 1, -0.3], [0.2, -0.3, 1]])
    u = K.pseudo(K.t_copula_sample(r, 4, 600, np.random.default_rng(8)))
    u[0] = 1e-9
    best = None
    for nu in range(2, 21):
        t = K.t_ppf(np.minimum(np.maximum(u, 1e-6), 1 - 1e-6), nu)
        c = np.array([[np.cov(t[:, i], t[:, j])[0, 1] / np.sqrt(t[:, i].var(ddof=1) * t[:, j].var(ddof=1)) for j in range(3)] for i in range(3)])
        like = 0.0
        for row in t:
            q = row @ np.linalg.solve(c, row)
            like += math.lgamma((nu + 3) / 2) - math.lgamma(nu / 2) - 1.5 * math.log(nu * math.pi) - 0.5 * math.log(np.linalg.det(c)) - (nu + 3) / 2 * math.log(1 + q / nu)
            like -= sum(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log(1 + x * x / nu) for x in row)
        if best is None or like > best[2]:
            best = (c, nu, like)
    got = K.t_copula_fit(u)
    assert got[1] == best[1] and got[2] == pytest.approx(best[2]) and np.allclose(got[0], best[0])


def test_tails_of_laws():
    assert K.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-5) and K.chi2_tail(31.410, 20) == pytest.approx(0.05, abs=1e-5)
    assert K.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-5) and K.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5) and K.f_tail(2.6955, 3, 100) == pytest.approx(0.05, abs=1e-4)
    assert K.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_garch_models_are_nested():
    r = np.random.default_rng(6).standard_t(5, 1500)
    plain, gjr, normal = K.garch_fit(r), K.garch_fit(r, leverage=True), K.garch_fit(r, normal=True)
    assert gjr["loglik"] >= plain["loglik"] - 0.5 and plain["loglik"] > normal["loglik"] + 10 and normal["nu"] == 0


def test_chi_squared_tail_of_odd_and_even_degrees():
    # fixed values: 5% points of chi-squared
    for df, x in ((1, 3.841), (2, 5.991), (3, 7.815), (5, 11.070), (10, 18.307), (19, 30.144), (49, 66.339)):
        assert K.chi2_tail(x, df) == pytest.approx(0.05, abs=2e-5)


def test_groups_test_of_uniform_numbers():
    u = np.random.default_rng(1).random(4000)
    assert K.uniform_groups_p(u, 20) > 0.01 and K.uniform_groups_p(u**1.3, 20) < 1e-6
    assert K.uniform_groups_p(np.array([0.0, 1.0, 0.49, 0.51]), 2) == 1


def garch_sample(n, omega, rng):
    s, out = 1.0, []
    for k in range(n):
        e = np.sqrt(s) * rng.standard_normal()
        out.append(e)
        s = omega(k) + 0.1 * e * e + 0.85 * s
    return np.array(out)


def test_constant_parameters_pass_nyblom_and_a_break_does_not():
    rng = np.random.default_rng(5)
    # a break of the mean: one of the variance's level mostly goes into the persistence
    steady, broken = garch_sample(2000, lambda k: 0.05, rng), garch_sample(2000, lambda k: 0.05, rng) + np.where(np.arange(2000) < 1000, 0.0, 0.5)
    for x, low in ((steady, True), (broken, False)):
        f = K.garch_fit(x, normal=True)
        assert K.garch_loglik(x, f["mu"], f["omega"], f["alpha"], f["beta"]).sum() == pytest.approx(f["loglik"])
        j, k = K.nyblom(x, f)
        assert k == 4 and (j < 1.24) == low
