"""ARMA orders by exact likelihood: a Kalman filter in lanes, one for each order, until its gain settles; then the plain recursion, which is the same."""

from __future__ import annotations

import math

import numpy as np

from .volatility import maximise

#: Days of the full filter; of all orders up to 5 whose roots are away from 1 the gain has settled long before.
SETTLED = 120


def polynomial(p: np.ndarray) -> np.ndarray:
    """Coefficients (lanes, k) of a stationary polynomial from any numbers (lanes, k), by partial autocorrelations tanh(p)."""
    r = np.tanh(p)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, k] = r[:, k]
        out[:, :k] = before - r[:, k : k + 1] * before[:, ::-1]
    return out


def loglik(x: np.ndarray, phi: np.ndarray, theta: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood with the variance at its best, that variance) of lanes of phi and theta (lanes, d) with means mu: exact but for what SETTLED leaves."""
    lanes, d = phi.shape
    m = d + 1
    t = np.zeros((lanes, m, m))
    t[:, :d, 0] = phi
    t[:, np.arange(m - 1), np.arange(1, m)] = 1
    r = np.concatenate([np.ones((lanes, 1)), theta], 1)
    q = r[:, :, None] * r[:, None, :]
    p = _stationary(t, q)
    a = np.zeros((lanes, m))
    y = x[None] - mu[:, None]
    n = len(x)
    v, logs, e = np.zeros(lanes), np.zeros(lanes), np.zeros((lanes, n))
    back = t.transpose(0, 2, 1)
    first = min(SETTLED, n)
    for k in range(min(SETTLED, n)):
        f = np.maximum(p[:, 0, 0], 1e-12)
        e[:, k] = y[:, k] - a[:, 0]
        v += e[:, k] ** 2 / f
        logs += np.log(f)
        gain = p[:, :, 0] / f[:, None]
        a = np.einsum("lij,lj->li", t, a + gain * e[:, k : k + 1])
        after = t @ (p - gain[:, :, None] * p[:, :1]) @ back + q
        if k % 10 == 9 and np.abs(after - p).max() < 1e-13:
            first = k + 1
            break
        p = after
    ar = y.copy()
    for j in range(d):
        ar[:, j + 1 :] -= phi[:, j : j + 1] * y[:, : n - j - 1]
    for k in range(max(first, d), n):
        e[:, k] = ar[:, k] - (theta * e[:, k - d : k][:, ::-1]).sum(1)
    v += (e[:, first:] ** 2).sum(1)
    s = np.maximum(v / n, 1e-300)
    return -0.5 * n * (math.log(2 * math.pi) + 1 + np.log(s)) - 0.5 * logs, s


def _stationary(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p = t p t' + q, by doubling."""
    p, a = q.copy(), t.copy()
    for _ in range(40):
        p = p + a @ p @ a.transpose(0, 2, 1)
        a = a @ a
        if np.abs(a).max() < 1e-12:
            break
    return p


def orders(most: int) -> list[tuple[int, int]]:
    return [(p, q) for p in range(most + 1) for q in range(most + 1)]


def best(x: np.ndarray, most: int = 5, rounds: int = 40) -> list[dict]:
    """All orders up to `most`, by AIC: (p, q), ar, ma, mu, variance, log-likelihood and AIC (the variance counts as a parameter)."""
    own = orders(most)
    scale = float(x.std()) or 1.0
    z = (x - x.mean()) / scale
    width = 2 * most + 1
    mask = np.array([[1.0] * p + [0.0] * (most - p) + [1.0] * q + [0.0] * (most - q) + [1.0] for p, q in own])

    def parts(points, lanes):
        w = points * mask[lanes]
        return polynomial(w[:, :most]) * _upto(mask[lanes, :most]), -polynomial(w[:, most : 2 * most]) * _upto(mask[lanes, most : 2 * most]), w[:, -1]

    starts = np.tile(np.concatenate([np.full(most, 0.1), np.full(most, 0.05), [0.0]]), (len(own), 1)) * mask
    with np.errstate(all="ignore"):
        at, ll = maximise(lambda points, lanes: loglik(z, *parts(points, lanes))[0], starts.reshape(len(own), width), rounds)
        phi, theta, mu = parts(at, np.arange(len(own)))
        s = loglik(z, phi, theta, mu)[1]
    out = []
    for k, (p, q) in enumerate(own):
        ll_x = float(ll[k]) - len(x) * math.log(scale)
        out.append({"p": p, "q": q, "ar": phi[k, :p].tolist(), "ma": theta[k, :q].tolist(), "mu": float(mu[k]) * scale + float(x.mean()), "variance": float(s[k]) * scale**2, "loglik": ll_x, "aic": 2 * (p + q + 2) - 2 * ll_x})
    return sorted(out, key=lambda f: (f["aic"], f["p"] + f["q"]))


def _upto(mask: np.ndarray) -> np.ndarray:
    """Coefficients beyond an order are 0 by their partial autocorrelations already; this makes them exactly so."""
    return (np.cumsum(mask[:, ::-1], 1)[:, ::-1] > 0).astype(float)
