"""Numerical kernels for grouped tasks: distributions, likelihood fits and copulas, in numpy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# --- a small optimiser ----------------------------------------------------------------------------------------------------------------


def minimise(f, x0, step=0.1, rounds: int = 400, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Nelder-Mead."""
    x0 = np.asarray(x0, float)
    n = len(x0)
    pts = np.vstack([x0, x0 + np.eye(n) * np.where(x0 != 0, np.abs(x0) * step, step)])
    vals = np.array([f(p) for p in pts])
    for _ in range(rounds):
        order = np.argsort(vals)
        pts, vals = pts[order], vals[order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        mid = pts[:-1].mean(0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < vals[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < vals[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, vals[-1]):
                pts[-1], vals[-1] = c, fc
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                vals[1:] = [f(p) for p in pts[1:]]
    i = int(np.argmin(vals))
    return pts[i], float(vals[i])


# --- distributions --------------------------------------------------------------------------------------------------------------------


def norm_ppf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf)(np.clip(p, 1e-15, 1 - 1e-15))


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))(x)


def t_logpdf(x, nu: float):
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(np.square(x) / nu)


@lru_cache(maxsize=64)
def _t_table(nu: float) -> tuple[np.ndarray, np.ndarray]:
    """Points and the distribution function of Student's t there, by fine trapezia in asinh(x)."""
    y = np.linspace(0, math.asinh(1e4 if nu < 3 else 2e3), 40_001)
    x = np.sinh(y)
    f = np.exp(t_logpdf(x, nu)) * np.cosh(y)
    c = np.concatenate(([0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(y))))
    return x, 0.5 + c


def t_cdf(x, nu: float):
    at, c = _t_table(nu)
    p = np.interp(np.abs(x), at, c)
    return np.where(np.asarray(x) < 0, 1 - p, p)


def t_ppf(p, nu: float):
    at, c = _t_table(nu)
    p = np.asarray(p, float)
    x = np.interp(np.where(p < 0.5, 1 - p, p), c, at)
    return np.where(p < 0.5, -x, x)


def t_fit(x: np.ndarray, least: float = 2.01) -> tuple[float, float, float]:
    """(nu, location, scale) by maximum likelihood."""
    m, s = float(np.median(x)), float(x.std()) or 1.0

    def cost(p):
        nu, scale = least + math.exp(min(p[0], 6)), math.exp(p[2])
        return -(t_logpdf((x - p[1]) / scale, nu) - p[2]).sum()

    p, _ = minimise(cost, [1.0, m, math.log(s * 0.7)], rounds=250)
    return least + math.exp(min(p[0], 6)), float(p[1]), math.exp(p[2])


def gpd_fit(y: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto distribution of excesses y > 0. The likelihood is profiled: given xi / sigma the shape is a mean."""
    m = float(y.mean())
    top = float(y.max())

    def profile(theta):  # theta = xi / sigma over -1 / max
        u = 1 + theta * y
        if (u <= 0).any():
            return math.inf, 0.0
        xi = float(np.log(u).mean())
        if abs(theta * m) < 1e-10 or xi == 0:
            return len(y) * (math.log(m) + 1), 0.0
        s = xi / theta
        return (len(y) * (math.log(s) + 1 + xi), xi) if s > 0 else (math.inf, 0.0)

    grid = np.concatenate((-np.geomspace(1e-6, 0.9999, 60)[::-1] / top, np.geomspace(1e-6, 1e3, 120) / m))
    best = min(grid, key=lambda t: profile(t)[0])
    near, _ = minimise(lambda p: profile(p[0])[0], [best], step=0.05, rounds=80, tol=1e-12)
    theta = near[0]
    cost, xi = profile(theta)
    if cost > len(y) * (math.log(m) + 1) - 1e-12 and abs(theta * m) < 1e-4:
        return 0.0, m
    return xi, xi / theta


def gpd_cdf(y, xi: float, sigma: float):
    return 1 - np.exp(-y / sigma) if abs(xi) < 1e-9 else 1 - np.maximum(0, 1 + xi * y / sigma) ** (-1 / xi)


def ks_p(d: float, n: int) -> float:
    """Kolmogorov's limit law with Stephens' correction."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def ks_against(x: np.ndarray, cdf) -> float:
    x = np.sort(x)
    n, c = len(x), cdf(np.sort(x))
    return float(max((np.arange(1, n + 1) / n - c).max(), (c - np.arange(n) / n).max()))


# --- peaks over threshold -------------------------------------------------------------------------------------------------------------

POT_FIELDS = ("var", "var_raw", "var_mle", "xi", "xi_raw", "clamped", "sigma", "n_u", "f_u", "u", "ks_p", "fallback", "es", "es_raw", "es_mle", "es_fallback")


def pot(x: np.ndarray, q: float, alpha: float, fewest: int = 10, floor: bool = True) -> dict:
    """VaR and ES of a loss sample by peaks over the q-quantile, with a reason wherever the sample's own tail is taken instead.

    floor: estimates aren't under 0 (losses in money); without it, failed fits give no raw values (residuals).
    """
    if alpha <= q:
        raise ValueError("alpha must exceed the threshold's quantile")
    least = 0.0 if floor else -math.inf
    u = float(np.quantile(x, q))
    y = x[x > u] - u
    n, k = len(x), len(y)
    f_u = 1 - k / n
    own = max(float(np.quantile(x, alpha)), least)
    top = x[x >= float(np.quantile(x, alpha))]
    own_es = max(float(top.mean()), own, least)
    out = dict.fromkeys(POT_FIELDS) | {"var": own, "var_raw": own if floor else None, "clamped": False, "n_u": k, "f_u": f_u, "u": u, "es": own_es}
    if alpha <= f_u or k < fewest:
        why = "alpha_below_threshold" if alpha <= f_u else "few_exceedances"
        return out | {"var_raw": own, "fallback": why, "es_fallback": why}
    xi_raw, sigma = gpd_fit(y)
    failed = {"fallback": "gpd_fit_failed", "es_fallback": "gpd_fit_failed"}
    if not math.isfinite(sigma) or sigma <= 0:
        return out | failed
    xi = min(max(xi_raw, -0.5), 1.0)
    ratio = n / k * (1 - alpha)

    def quantile(s):
        v = u - sigma * math.log(ratio) if abs(s) < 1e-4 else u + sigma / s * (ratio**-s - 1)
        return v if math.isfinite(v) else None

    def shortfall(v, s):
        return None if v is None or s >= 1 else v + sigma if abs(s) < 1e-4 else (v + sigma - s * u) / (1 - s)

    raw, mle = quantile(xi), quantile(xi_raw)
    out |= {"xi_raw": xi_raw, "clamped": xi != xi_raw, "sigma": sigma}
    if raw is None:
        return out | failed | {"var_raw": None}
    out |= {"var_raw": raw, "var_mle": mle}
    if raw < u:
        return out | {"fallback": "q_below_threshold", "es_fallback": "q_below_threshold"}
    var, es = max(raw, least), shortfall(raw, xi)
    if xi >= 1:
        why, final = "xi_ge_1_gpd_es_undefined", max(own_es, var)
    elif es is None or es < var:
        why, final = "es_invalid_empirical_fallback", max(own_es, var)
    else:
        why, final = "none", max(es, var, least)
    ks = None if xi != xi_raw else ks_p(ks_against(y, lambda v: gpd_cdf(v, xi, sigma)), k)
    return out | {"var": var, "xi": xi, "ks_p": ks, "fallback": "none", "es": final, "es_raw": es, "es_mle": shortfall(mle, xi_raw), "es_fallback": why}


# --- GARCH(1,1) with t innovations ----------------------------------------------------------------------------------------------------


def garch_variance(e: np.ndarray, omega: float, alpha: float, beta: float, first: float, leverage: float = 0.0, block: int = 64) -> np.ndarray:
    """Conditional variances of residuals e, and the next one (one more entry).

    s' = x + beta s is linear in s: within a block it is a triangular matrix of powers of beta, and only the blocks' ends follow one by one.
    """
    n = len(e)
    x = omega + (alpha + leverage * (e < 0)) * e * e
    powers = beta ** np.arange(block + 1)
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    inner = np.pad(x, (0, -n % block)).reshape(-1, block) @ np.where(lag >= 0, powers[np.abs(lag)], 0.0).T
    s, starts = first, np.empty(len(inner))
    for k in range(len(inner)):
        starts[k] = s
        s = inner[k, -1] + powers[-1] * s
    return np.concatenate(([first], np.maximum((inner + starts[:, None] * powers[1:]).ravel()[:n], 1e-12)))


def backcast(e: np.ndarray) -> float:
    """The start variance: squares of the first 75 residuals, weighted by 0.94 ** age."""
    k = min(75, len(e))
    w = 0.94 ** np.arange(k)
    return float((w * e[:k] ** 2).sum() / w.sum()) or 1e-8


def garch_loglik(r: np.ndarray, mu: float, omega: float, alpha: float, beta: float, gamma: float = 0.0, nu: float = 0.0) -> np.ndarray:
    """Each observation's log density; nu 0 is the normal law."""
    e = r - mu
    s = garch_variance(e, omega, alpha, beta, backcast(e), gamma)[:-1]
    if not nu:
        return -0.5 * (math.log(2 * math.pi) + np.log(s) + e * e / s)
    c = math.sqrt((nu - 2) / nu)
    return t_logpdf(e / np.sqrt(s) / c, nu) - 0.5 * np.log(s) - math.log(c)


def nyblom(r: np.ndarray, fit: dict) -> tuple[float, int]:
    """(joint statistic, parameters) of the test that a GARCH fit's parameters are constant, from numerical scores."""
    names = ["mu", "omega", "alpha", "beta"] + ["gamma"] * (fit["gamma"] > 0) + ["nu"] * (fit["nu"] > 0)
    base = {k: fit[k] for k in ("mu", "omega", "alpha", "beta", "gamma", "nu")}
    scores = np.empty((len(r), len(names)))
    for j, k in enumerate(names):
        h = 1e-4 * max(abs(base[k]), 1e-2)
        scores[:, j] = (garch_loglik(r, **base | {k: base[k] + h}) - garch_loglik(r, **base | {k: base[k] - h})) / (2 * h)
    sums = np.cumsum(scores, 0)
    return float(np.einsum("ij,jk,ik->", sums, np.linalg.pinv(scores.T @ scores), sums)) / len(r), len(names)


def uniform_groups_p(u: np.ndarray, groups: int) -> float:
    """Pearson's test that u is uniform, from its counts in equal groups."""
    n = np.bincount(np.minimum((u * groups).astype(int), groups - 1), minlength=groups)
    return chi2_tail(float(((n - len(u) / groups) ** 2).sum()) * groups / len(u), groups - 1)


def garch_fit(r: np.ndarray, leverage: bool = False, normal: bool = False) -> dict:
    """Maximum likelihood of a constant mean GARCH(1,1) (GJR with leverage) with unit-variance t innovations, or normal ones (nu is 0 then). r
    should be of the order of 1."""
    v = float(r.var()) or 1e-8

    def unpack(p):
        alpha, beta = 1 / (1 + math.exp(-p[1])), 1 / (1 + math.exp(-p[2]))
        beta *= 1 - alpha  # alpha + beta stays under 1
        return p[0], alpha, beta, (0.0 if normal else 2.05 + math.exp(min(p[-1], 5))), v * math.exp(p[3]), (math.exp(p[4]) if leverage else 0.0)

    def cost(p):
        if np.abs(p[1:]).max() > 30:
            return math.inf
        mu, alpha, beta, nu, omega, gamma = unpack(p)
        if gamma / 2 + alpha + beta >= 1:
            return math.inf
        return -garch_loglik(r, mu, omega, alpha, beta, gamma, nu).sum()

    start = [float(r.mean()), -2.5, 2.0, math.log(0.1)] + [-3.0] * leverage + [1.5] * (not normal)
    p, best = minimise(cost, start, step=0.2, rounds=220, tol=1e-8)
    mu, alpha, beta, nu, omega, gamma = unpack(p)
    e = r - mu
    s = garch_variance(e, omega, alpha, beta, backcast(e), gamma)
    return {"mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "nu": nu, "gamma": gamma, "loglik": -best, "next": float(s[-1]), "sigma": np.sqrt(s[:-1])}


# --- copulas --------------------------------------------------------------------------------------------------------------------------


def nearest_pd(m: np.ndarray, least: float = 1e-8) -> np.ndarray:
    w, q = np.linalg.eigh((m + m.T) / 2)
    m = q @ np.diag(np.maximum(w, least)) @ q.T
    d = np.sqrt(np.diag(m))
    return m / np.outer(d, d)


def pseudo(x: np.ndarray) -> np.ndarray:
    """Ranks over n + 1, ties at their mean, column by column."""
    out = np.empty(x.shape)
    for j in range(x.shape[1]):
        _, inverse, n = np.unique(x[:, j], return_inverse=True, return_counts=True)
        out[:, j] = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return out / (len(x) + 1)


def t_scores_correlation(u: np.ndarray, nu: float, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(scores, correlation) of pseudo-observations as quantiles of t with nu degrees of freedom."""
    z = t_ppf(np.clip(u, eps, 1 - eps), nu)
    r = np.corrcoef(z, rowvar=False)
    return z, nearest_pd(r) if np.linalg.eigvalsh(r).min() < 1e-8 else r


def t_copula_fit(u: np.ndarray, grid=range(2, 21)) -> tuple[np.ndarray, int, float]:
    """(correlation, nu, log-likelihood) of greatest profile likelihood; each nu has the correlation of its own scores."""
    d, best = u.shape[1], None
    for nu in grid:
        z, r = t_scores_correlation(u, nu)
        quad = np.einsum("ij,jk,ik->i", z, np.linalg.inv(r), z)
        joint = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - d / 2 * math.log(nu * math.pi) - float(np.linalg.slogdet(r)[1]) / 2 - (nu + d) / 2 * np.log1p(quad / nu)
        like = float((joint - t_logpdf(z, nu).sum(1)).sum())
        if math.isfinite(like) and (best is None or like > best[2]):
            best = (r, nu, like)
    return best or (t_scores_correlation(u, 5)[1], 5, -math.inf)


def t_copula_sample(r: np.ndarray, nu: float, n: int, rng: np.random.Generator) -> np.ndarray:
    z = rng.standard_normal((n, len(r))) @ np.linalg.cholesky(r).T
    return np.clip(t_cdf(z / np.sqrt(rng.chisquare(nu, n) / nu)[:, None], nu), 1e-9, 1 - 1e-9)


def empirical_copula(u: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The share of u that is at or under each point; blocks bound the memory."""
    return np.concatenate([(u[None] <= at[i : i + 200, None]).all(2).mean(1) for i in range(0, len(at), 200)])


def cvm(u: np.ndarray, r: np.ndarray, nu: float, seed: int, draws: int = 10_000) -> float:
    """Cramer-von Mises distance of u's empirical copula from a t copula, the latter by simulation."""
    s = t_copula_sample(r, nu, draws, np.random.default_rng(seed))
    return float(((empirical_copula(u, u) - empirical_copula(s, u)) ** 2).sum())


# --- tests of residuals ---------------------------------------------------------------------------------------------------------------


def ljung_box(x: np.ndarray, lags: int) -> float:
    c = x - x.mean()
    v, n = float(c @ c), len(c)
    return n * (n + 2) * sum((float(c[k:] @ c[:-k]) / v) ** 2 / (n - k) for k in range(1, lags + 1))


def chi2_tail(x: float, df: int) -> float:
    """1 - distribution function of chi-squared: a finite sum, which for odd degrees of freedom begins with a normal tail."""
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    return math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * sum((x / 2) ** (k + 0.5) / math.gamma(k + 1.5) for k in range(df // 2))


def gamma_tail(x: float, shape: float) -> float:
    """The regularised upper incomplete gamma function: by its series for small x, by a continued fraction else."""
    if x <= 0:
        return 1.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        for k in range(1, 2000):
            term *= x / (shape + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - shape
    c, d = 1 / tiny, 1 / b
    out = d
    for k in range(1, 2000):
        a = -k * (k - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def weighted_tail(q: float, lags: int, fitted: int) -> float | None:
    """1 - distribution function of a weighted portmanteau statistic, a gamma law of its first two moments; None where these give none."""
    rest = 2 * lags * lags + 3 * lags + 1 - 6 * lags * fitted
    if rest <= 0:
        return None
    return gamma_tail(q / (2 / 3 * rest / (lags * (lags + 1))), 0.75 * (lags + 1) ** 2 * lags / rest)


def weighted_ljung_box(x: np.ndarray, lags: int, fitted: int = 0) -> tuple[float, float]:
    """(statistic, p): squared autocorrelations with weights that fall from 1; where the gamma law has no moments, the plain test."""
    c = x - x.mean()
    v, n = float(c @ c), len(c)
    own = [(float(c[k:] @ c[:-k]) / v) ** 2 / (n - k) * n * (n + 2) for k in range(1, lags + 1)]
    q = sum((lags - k) / lags * s for k, s in enumerate(own))
    p = weighted_tail(q, lags, fitted)
    return (q, p) if p is not None else (sum(own), gamma_tail(sum(own) / 2, (lags - fitted) / 2))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by the continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def f_tail(x: float, d1: float, d2: float) -> float:
    """1 - distribution function of F."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(x: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + x * x))


# --- prices, for simulated scenarios --------------------------------------------------------------------------------------------------


def straddle(s, k, t, r, v):
    w = v * np.sqrt(t)
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / w
    return s * (2 * fast_norm_cdf(d1) - 1) - k * np.exp(-r * t) * (2 * fast_norm_cdf(d1 - w) - 1)


_X = np.linspace(-9, 9, 36_001)
_P = norm_cdf(_X)


def fast_norm_cdf(x):
    return np.interp(x, _X, _P)


_CUT = int(np.searchsorted(_P, 0.5, "right"))


def fast_norm_ppf(p):
    """By the lower half of the table, where it is exact to the last places."""
    x = np.interp(np.minimum(p, 1 - p), _P[:_CUT], _X[:_CUT])
    return np.where(np.asarray(p) < 0.5, x, -x)


def irs(rate, notional: float, fixed: float, years: int = 10):
    v = 1 / (1 + rate)
    a = np.zeros_like(v)
    for _ in range(years):
        a = v * (1 + a)
    return notional * (rate - fixed) * a
