"""GARCH models of four kinds with ARMA means and any law of laws.py, fitted many at once: each parameter vector is a lane of the recursions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from . import kernels as K
from . import laws

MODELS = ("garch", "gjr", "egarch", "aparch")


def maximise(f: Callable, starts: np.ndarray, rounds: int = 60, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of BFGS with forward differences: f takes points (m, p) and their lanes (m,), and gives m values; starts is (lanes, p).

    All lanes move together, so each round calls f twice or so, with every lane's steps in it.
    """
    x = np.array(starts, float)
    lanes, p = x.shape
    every = np.arange(lanes)
    value = _good(f(x, every))
    h = np.tile(np.eye(p), (lanes, 1, 1)) * 0.02
    live = np.ones(lanes, bool)

    def gradient(own):
        step = 1e-5 * np.maximum(1, np.abs(x[own]))
        up = np.repeat(x[own], p, 0).reshape(len(own), p, p)
        up[:, np.arange(p), np.arange(p)] += step
        return (_good(f(up.reshape(-1, p), np.repeat(own, p))).reshape(len(own), p) - value[own, None]) / step

    g = gradient(every)
    for _ in range(rounds):
        own = np.flatnonzero(live)
        if not len(own):
            break
        d = np.einsum("lij,lj->li", h[own], g[own])
        slope = (d * g[own]).sum(1)
        back = slope <= 0
        d[back], slope[back] = g[own][back] * 1e-3, (g[own][back] ** 2).sum(1) * 1e-3
        d *= np.minimum(1, 2 / np.maximum(np.abs(d).max(1), 1e-300))[:, None]
        # four step lengths at once; the best counts
        sizes = np.array([1.0, 0.3, 0.06, 0.005])
        tries = x[own][:, None] + sizes[None, :, None] * d[:, None]
        got = _good(f(tries.reshape(-1, p), np.repeat(own, len(sizes)))).reshape(len(own), -1)
        best = got.argmax(1)
        gain = got[np.arange(len(own)), best] - value[own]
        moved = gain > 0
        old, before = g[own].copy(), x[own].copy()
        x[own[moved]] = tries[moved, best[moved]]
        value[own[moved]] += gain[moved]
        g[own] = gradient(own)
        s, y = x[own] - before, old - g[own]  # of the negative, which is least
        sy = (s * y).sum(1)
        for k in np.flatnonzero(moved & (sy > 1e-12)):
            r, a = 1 / sy[k], np.eye(p)
            left = a - r * np.outer(s[k], y[k])
            h[own[k]] = left @ h[own[k]] @ left.T + r * np.outer(s[k], s[k])
        # a lane that stalls begins again from the gradient once
        stalled = ~moved | (gain < tol * (1 + np.abs(value[own])))
        fresh = np.array([np.allclose(h[i], np.eye(p) * 1e-3) for i in own])
        live[own[stalled & fresh]] = False
        h[own[stalled & ~fresh]] = np.eye(p) * 1e-3
    return x, value


def _good(v: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(v), v, -1e12)


def residuals(r: np.ndarray, mu: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """e (n, lanes) of an ARMA mean; ar (p, lanes) and ma (q, lanes). What is before the first day is the mean, without residuals."""
    x = r[:, None] - mu[None]
    e = x.copy()
    for k in range(len(ar)):
        e[k + 1 :] -= ar[k] * x[: -k - 1]
    q, back = len(ma), ma[::-1]
    for t in range(1, len(r) if q else 0):
        k = min(q, t)
        e[t] -= (back[q - k :] * e[t - k : t]).sum(0)
    return e


def variance(model: str, e: np.ndarray, omega, alpha, beta, gamma, delta, m) -> np.ndarray:
    """Conditional variances (n + 1, lanes) of residuals e (n, lanes), the next one last. m: E|z| of the law, which egarch needs."""
    n = len(e)
    k = min(75, n)
    w = 0.94 ** np.arange(k)
    first = np.maximum((w[:, None] * e[:k] ** 2).sum(0) / w.sum(), 1e-8)
    out = np.empty((n + 1, e.shape[1]))
    if model == "egarch":
        s, level = np.log(first), omega - gamma * m
        for t in range(n):
            out[t] = s
            z = e[t] * np.exp(-0.5 * s)
            s = np.minimum(np.maximum(level + alpha * z + gamma * np.abs(z) + beta * s, -40.0), 40.0)
        out[n] = s
        return np.exp(out)
    if model == "aparch":
        x = omega + alpha * np.maximum(np.abs(e) - gamma * e, 1e-12) ** delta
        s = first ** (delta / 2)
    else:
        x = omega + (alpha + (gamma * (e < 0) if model == "gjr" else 0.0)) * e * e
        s = first
    for t in range(n):
        out[t] = s
        s = np.minimum(x[t] + beta * s, 1e12)
    out[n] = s
    return np.maximum(out, 1e-12) ** (2 / delta if model == "aparch" else 1.0)


def _shape(model: str, law: str, order: tuple[int, int]) -> list[str]:
    more = {"garch": [], "gjr": ["gamma"], "egarch": ["gamma"], "aparch": ["gamma", "delta"]}[model]
    return ["mu", *(f"ar{k + 1}" for k in range(order[0])), *(f"ma{k + 1}" for k in range(order[1])), "omega", "alpha", "beta", *more, *laws.LAWS[law].names]


def unpack(model: str, law: str, order: tuple[int, int], p: np.ndarray, v: float) -> dict:
    """Parameters by name, each a row of lanes, from points (lanes, p) on the whole line; v: the sample's variance."""
    at = iter(p.T)
    out = {"mu": next(at), "ar": np.array([np.tanh(next(at)) for _ in range(order[0])]), "ma": np.array([np.tanh(next(at)) for _ in range(order[1])])}
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    if model == "egarch":
        out |= {"omega": next(at), "alpha": next(at), "beta": 0.9999 * np.tanh(next(at)), "gamma": next(at), "delta": np.full(len(p), 2.0)}
        out["omega"] = (out["omega"] + math.log(v)) * (1 - out["beta"])  # around the sample's own level
    else:
        omega, alpha, beta = v * np.exp(np.clip(next(at), -30, 10)), logistic(next(at)), logistic(next(at))
        out |= {"alpha": alpha, "beta": beta * (1 - alpha), "gamma": np.zeros(len(p)), "delta": np.full(len(p), 2.0)}
        if model == "gjr":
            out["gamma"] = np.exp(np.clip(next(at), -30, 2))
        elif model == "aparch":
            out |= {"gamma": np.tanh(next(at)), "delta": 0.3 + 3.7 * logistic(next(at))}
            omega = omega * v ** (out["delta"] / 2 - 1)
        out["omega"] = omega
    names = laws.LAWS[law].names
    out |= dict(zip(names, laws.LAWS[law].values([next(at) for _ in names])))
    return out


def start(model: str, law: str, order: tuple[int, int], r: np.ndarray) -> list[float]:
    own = {"garch": [math.log(0.1), -2.5, 2.0], "gjr": [math.log(0.1), -2.5, 2.0, -3.0], "egarch": [0.0, 0.0, 1.5, 0.15], "aparch": [math.log(0.1), -2.5, 2.0, 0.05, 0.0]}[model]
    return [float(r.mean()), *[0.05] * order[0], *[0.0] * order[1], *own, *laws.LAWS[law].free]


def filtered(model: str, order: tuple[int, int], r: np.ndarray, parts: list[tuple[str, np.ndarray]]) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    """(parameters, residuals, variances) of several laws' points, each (law, points): all their lanes go through one loop over time."""
    v = float(r.var()) or 1e-8
    with np.errstate(all="ignore"):
        qs = [unpack(model, law, order, p, v) for law, p in parts]
        for q, (law, p) in zip(qs, parts):
            q["m"] = np.broadcast_to(_abs(law, [q[k] for k in laws.LAWS[law].names]), len(p)) if model == "egarch" else np.zeros(len(p))
        both = {k: np.concatenate([q[k] for q in qs], -1) for k in ("mu", "ar", "ma", "omega", "alpha", "beta", "gamma", "delta", "m") if qs[0][k].size}
        none = np.zeros((0, len(both["mu"])))
        e = residuals(r, both["mu"], both.get("ar", none), both.get("ma", none))
        s = variance(model, e, *(both[k] for k in ("omega", "alpha", "beta", "gamma", "delta", "m")))
    ends = np.cumsum([len(p) for _, p in parts])
    return [(q, e[:, b - len(p) : b], s[:, b - len(p) : b]) for q, (_, p), b in zip(qs, parts, ends)]


def _density(law: str, q: dict, e: np.ndarray, s: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return laws.LAWS[law].logpdf(e / np.sqrt(s[:-1]), *(q[k] for k in laws.LAWS[law].names)) - 0.5 * np.log(s[:-1])


def _allowed(model: str, q: dict, ll: np.ndarray) -> np.ndarray:
    """Parameters without a long-run variance have no likelihood."""
    return np.where(q["alpha"] + q["beta"] + q["gamma"] / 2 < 1, ll, -np.inf) if model in ("garch", "gjr") else ll


def densities(model: str, law: str, order: tuple[int, int], r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray, np.ndarray]:
    """(each day's log density in each lane, parameters, residuals, variances)."""
    ((q, e, s),) = filtered(model, order, r, [(law, p)])
    return _density(law, q, e, s), q, e, s


def loglik(model: str, law: str, order: tuple[int, int], r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray, np.ndarray]:
    """densities(), summed by lane."""
    d, q, e, s = densities(model, law, order, r, p)
    return _allowed(model, q, d.sum(0)), q, e, s


def _abs(law: str, p: list):
    """E|z| by lane; skewed laws and the last two at the values of their table's rule would cost a table a lane: Gauss sums do."""
    if law == "norm":
        return math.sqrt(2 / math.pi)
    if law == "std":
        return laws.std_abs(p[0])
    if law == "ged":
        return laws.ged_abs(p[0])
    y = np.linspace(-6.5, 6.5, 241)[:, None]
    x = np.sinh(y) / 3
    f = np.exp(laws.LAWS[law].logpdf(x, *p)) * np.cosh(y)
    return (np.abs(x) * f).sum(0) / f.sum(0)


def fit(r: np.ndarray, model: str, names: Sequence[str], order: tuple[int, int] = (0, 0), rounds: int = 60) -> list[dict]:
    """Maximum likelihood of one model with each of several laws, r of the order of 1. All laws' lanes share the recursion's loop over time."""
    out = []
    sizes = [len(start(model, law, order, r)) for law in names]
    width = max(sizes)
    x0 = np.zeros((len(names), width))
    for k, law in enumerate(names):
        x0[k, : sizes[k]] = start(model, law, order, r)

    def values(points, lanes):
        ll = np.empty(len(points))
        owns = [(k, own) for k in range(len(names)) if len(own := np.flatnonzero(lanes == k))]
        found = filtered(model, order, r, [(names[k], points[own, : sizes[k]]) for k, own in owns])
        for (k, own), (q, e, s) in zip(owns, found):
            ll[own] = _allowed(model, q, _density(names[k], q, e, s).sum(0))
        return ll

    x, best = maximise(values, x0, rounds)
    for k, law in enumerate(names):
        ll, q, e, s = loglik(model, law, order, r, x[k : k + 1, : sizes[k]])
        z = (e / np.sqrt(s[:-1]))[:, 0]
        p = tuple(float(q[n][0]) for n in laws.LAWS[law].names)
        own = {n: float(q[n][0]) for n in ("mu", "omega", "alpha", "beta", "gamma", "delta")}
        out.append(own | {
            "model": model, "law": law, "ar": q["ar"][:, 0].tolist() if order[0] else [], "ma": q["ma"][:, 0].tolist() if order[1] else [], "law_p": p, "loglik": float(ll[0]), "k": sizes[k], "order": order, "x": x[k, : sizes[k]],
            "z": z, "e": e[:, 0], "sigma": np.sqrt(s[:-1, 0]), "next": float(s[-1, 0]), "mean_abs": laws.mean_abs(law, p),
        })
    return out


def persistence(f: dict) -> float:
    """How much of a shock to the variance (its power, its logarithm) is left a day later."""
    if f["model"] == "egarch":
        return f["beta"]
    x, c = laws._table(f["law"], f["law_p"])
    mid, w = (x[1:] + x[:-1]) / 2, np.diff(c) / c[-1]
    if f["model"] == "aparch":
        return f["beta"] + f["alpha"] * float((np.maximum(np.abs(mid) - f["gamma"] * mid, 0) ** f["delta"] * w).sum())
    return f["alpha"] + f["beta"] + (f["gamma"] * float((mid * mid * (mid < 0) * w).sum()) if f["model"] == "gjr" else 0.0)


def long_run(f: dict) -> float | None:
    """The variance that the model goes back to; None if there is none. Of egarch the one at its mean logarithm."""
    p = persistence(f)
    if p >= 1:
        return None
    if f["model"] == "egarch":
        return math.exp(f["omega"] / (1 - p))
    return (f["omega"] / (1 - p)) ** (2 / f["delta"])


def advance(f: dict, s: float, e: float) -> float:
    """The variance after residual e, of one fit."""
    return float(variance_step(f["model"], s, e, f["omega"], f["alpha"], f["beta"], f["gamma"], f["delta"], f["mean_abs"]))


def variance_step(model: str, s, e, omega, alpha, beta, gamma, delta, m):
    if model == "egarch":
        z = e / math.sqrt(s)
        return math.exp(min(max(omega + alpha * z + gamma * (abs(z) - m) + beta * math.log(s), -40.0), 40.0))
    if model == "aparch":
        return max(omega + alpha * max(abs(e) - gamma * e, 1e-12) ** delta + beta * s ** (delta / 2), 1e-12) ** (2 / delta)
    return max(omega + (alpha + (gamma if model == "gjr" and e < 0 else 0.0)) * e * e + beta * s, 1e-12)


def nyblom(f: dict, r: np.ndarray) -> float:
    """The joint statistic of the test that a fit's parameters are constant, from numerical scores. It is the same for parameters on the whole line."""
    step = 1e-4 * np.maximum(1, np.abs(f["x"]))
    points = np.concatenate([f["x"] + np.diag(step), f["x"] - np.diag(step)])
    d = densities(f["model"], f["law"], f["order"], r, points)[0]
    k = len(step)
    scores = np.nan_to_num((d[:, :k] - d[:, k:]) / (2 * step))
    sums = np.cumsum(scores - scores.mean(0), 0)
    return float(np.einsum("ij,jk,ik->", sums, np.linalg.pinv(scores.T @ scores), sums)) / len(r)


def mean_of_next(f: dict, r: np.ndarray) -> float:
    """The forecast of the day after r by the fit's ARMA mean."""
    ar, ma = f["ar"], f["ma"]
    return f["mu"] + sum(a * (r[-1 - k] - f["mu"]) for k, a in enumerate(ar)) + sum(m * f["e"][-1 - k] for k, m in enumerate(ma))


def gof(f: dict, groups: Sequence[int] = (20, 30, 40, 50)) -> list[float]:
    """p values of Pearson's tests that the residuals follow the fit's law."""
    u = laws.cdf(f["law"], f["z"], *f["law_p"])
    return [K.uniform_groups_p(u, g) for g in groups]
