"""Seven families of a sample's law, by location, scale and up to two more parameters: likelihood fits from several starts, and draws."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import kernels as K
from . import laws
from .volatility import maximise


def _logistic(z):
    return -np.abs(z) - 2 * np.log1p(np.exp(-np.abs(z)))


def _t(z, nu):
    return laws.lgamma((nu + 1) / 2) - laws.lgamma(nu / 2) - 0.5 * np.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(z * z / nu)


def _st3(z, xi, nu):
    """Fernandez and Steel's skewed t, not brought to mean 0."""
    return np.log(2 / (xi + 1 / xi)) + _t(np.where(z < 0, z * xi, z / xi), nu)


def _st3_draw(rng, n, xi, nu):
    x = np.abs(rng.standard_t(nu, n))
    return np.where(rng.random(n) < xi * xi / (1 + xi * xi), x * xi, -x / xi)


def _by_table(name: str) -> Callable:
    return lambda rng, n, *p: laws.ppf(name, rng.random(n), *p)


_DF = (lambda p: 1.0 + np.exp(np.minimum(p, 5.0)), lambda v: math.log(v - 1.0))


@dataclass(frozen=True)
class Kind:
    """log density (z, *shape), draws (rng, n, *shape), names of the shape's parameters, their maps and several first values."""

    logpdf: Callable
    draw: Callable
    names: tuple[str, ...] = ()
    maps: tuple = ()
    starts: tuple = ((),)


def _of(law: str, starts) -> Kind:
    return Kind(laws.LAWS[law].logpdf, _by_table(law), laws.LAWS[law].names, laws.LAWS[law].maps, starts)


#: Normal, t, logistic, skewed t of mean 0 and variance 1, skewed t as it is, Johnson's SU, generalised error.
KINDS = {
    "NO": Kind(laws.norm, lambda rng, n: rng.standard_normal(n)),
    "TF": Kind(_t, lambda rng, n, nu: rng.standard_t(nu, n), ("shape",), (_DF,), ((3.0,), (10.0,))),
    "LO": Kind(_logistic, lambda rng, n: rng.logistic(size=n)),
    "SST": _of("sstd", ((0.8, 5.0), (1.2, 5.0), (1.0, 12.0))),
    "ST3": Kind(_st3, _st3_draw, ("skew", "shape"), (laws._SKEW, _DF), ((0.8, 5.0), (1.2, 5.0), (1.0, 12.0))),
    "JSU": _of("jsu", ((-0.5, 1.5), (0.5, 1.5), (0.0, 3.0))),
    "GED": _of("ged", ((1.2,), (1.9,))),
}


def fit(x: np.ndarray, name: str) -> dict:
    """Maximum likelihood of (mu, sigma, shape), the best of several starts."""
    kind = KINDS[name]
    m, s = float(np.median(x)), float(x.std()) or 1.0

    def values(points, _):
        mu, scale = points[:, 0] * s + m, s * np.exp(np.clip(points[:, 1], -6, 6))
        shape = [f(points[:, 2 + k]) for k, (f, _) in enumerate(kind.maps)]
        return (kind.logpdf((x[:, None] - mu) / scale, *shape) - np.log(scale)).sum(0)

    starts = np.array([[0.0, w, *(back(v) for v, (_, back) in zip(first, kind.maps))] for first in kind.starts for w in (0.0, -0.4)])
    with np.errstate(all="ignore"):
        at, ll = maximise(values, starts, 80)
    k = int(ll.argmax())
    shape = tuple(float(f(at[k, 2 + j])) for j, (f, _) in enumerate(kind.maps))
    n = 2 + len(shape)
    return {"family": name, "mu": float(at[k, 0] * s + m), "sigma": float(s * math.exp(at[k, 1])), "shape": shape, "loglik": float(ll[k]), "aic": 2 * n - 2 * float(ll[k]), "bic": n * math.log(len(x)) - 2 * float(ll[k])}


def ks_drawn(x: np.ndarray, f: dict, draws: int = 5000, seed: int = 42) -> tuple[float, float]:
    """(distance, p) of the two-sample test of x against draws of a fit."""
    y = f["mu"] + f["sigma"] * KINDS[f["family"]].draw(np.random.default_rng(seed), draws, *f["shape"])
    return ks_two(x, y)


def ks_two(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    both = np.sort(np.concatenate([x, y]))
    d = float(np.abs(np.searchsorted(np.sort(x), both, "right") / len(x) - np.searchsorted(np.sort(y), both, "right") / len(y)).max())
    return d, K.ks_p(d, int(len(x) * len(y) / (len(x) + len(y))))
