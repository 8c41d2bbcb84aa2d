"""Laws of innovations with mean 0 and variance 1: normal, Student t, generalised error, both skewed, normal inverse Gaussian, and Johnson's SU."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LOG2PI = math.log(2 * math.pi)
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x):
    return math.lgamma(x) if np.ndim(x) == 0 else _lgamma(x)


#: Polynomials of the modified Bessel functions I1 (argument to 3.75) and K1 (to 2, and beyond), lowest power first.
I1 = (0.5, 0.87890594, 0.51498869, 0.15084934, 0.02658733, 0.00301532, 0.00032411)
K1_NEAR = (1.0, 0.15443144, -0.67278579, -0.18156897, -0.01919402, -0.00110404, -0.00004686)
K1_FAR = (1.25331414, 0.23498619, -0.03655620, 0.01504268, -0.00780353, 0.00325614, -0.00068245)


def log_k1(x):
    """ln of the modified Bessel function of the second kind, order 1, of x > 0."""
    near = np.minimum(x, 2.0)
    i1 = near * np.polynomial.polynomial.polyval((near / 3.75) ** 2, I1)
    small = (np.polynomial.polynomial.polyval((near / 2) ** 2, K1_NEAR) + near * np.log(near / 2) * i1) / near
    far = np.maximum(x, 2.0)
    return np.where(x <= 2, np.log(small), np.log(np.polynomial.polynomial.polyval(2 / far, K1_FAR)) - far - 0.5 * np.log(far))


def norm(z):
    return -0.5 * (LOG2PI + z * z)


def std(z, nu):
    s = nu - 2  # variance 1
    return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(math.pi * s) - (nu + 1) / 2 * np.log1p(z * z / s)


def _ged_scale(nu):
    return np.exp(0.5 * (-2 / nu * math.log(2) + lgamma(1 / nu) - lgamma(3 / nu)))


def ged(z, nu):
    s = _ged_scale(nu)
    return np.log(nu) - 0.5 * np.abs(z / s) ** nu - np.log(s) - (1 + 1 / nu) * math.log(2) - lgamma(1 / nu)


def std_abs(nu):
    """E|z| of std."""
    return 2 * np.sqrt(nu - 2) / (nu - 1) * np.exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / math.sqrt(math.pi)


def ged_abs(nu):
    return _ged_scale(nu) * np.exp(math.log(2) / nu + lgamma(2 / nu) - lgamma(1 / nu))


def _skewed(z, xi, log_density, m):
    """Fernandez and Steel's skewing of a symmetric law with E|z| = m, brought back to mean 0 and variance 1."""
    mu = m * (xi - 1 / xi)
    s = np.sqrt((1 - m * m) * (xi * xi + 1 / (xi * xi)) + 2 * m * m - 1)
    x = z * s + mu
    return np.log(2 / (xi + 1 / xi)) + np.log(s) + log_density(np.where(x < 0, x * xi, x / xi))


def sstd(z, xi, nu):
    return _skewed(z, xi, lambda x: std(x, nu), std_abs(nu))


def sged(z, xi, nu):
    return _skewed(z, xi, lambda x: ged(x, nu), ged_abs(nu))


def nig(z, rho, zeta):
    """rho: skewness in (-1, 1); zeta: the greater, the nearer to the normal law."""
    alpha = np.sqrt(zeta) / (1 - rho * rho)
    beta, gamma = rho * alpha, alpha * np.sqrt(1 - rho * rho)
    delta = zeta / gamma
    y = z + delta * beta / gamma  # less the location
    q = np.sqrt(delta * delta + y * y)
    return np.log(alpha * delta / math.pi) + log_k1(alpha * q) - np.log(q) + delta * gamma + beta * y


def jsu(z, skew, tau):
    r = 1 / tau
    w = np.exp(r * r)
    omega = -skew * r
    c = 1 / np.sqrt(0.5 * (w - 1) * (w * np.cosh(2 * omega) + 1))
    x = (z - c * np.sqrt(w) * np.sinh(omega)) / c
    v = -skew + np.arcsinh(x) / r
    return -np.log(c) - np.log(r) - 0.5 * np.log1p(x * x) - 0.5 * LOG2PI - 0.5 * v * v


def _above(low: float, most: float = 60.0) -> tuple[Callable, Callable]:
    """low + exp(p), held under `most`, and back."""
    return lambda p: low + np.exp(np.minimum(p, math.log(most))), lambda v: math.log(v - low)


@dataclass(frozen=True)
class Law:
    """log density (z, *parameters), the parameters' names, first values, and maps from and to the whole line."""

    logpdf: Callable
    names: tuple[str, ...] = ()
    start: tuple[float, ...] = ()
    maps: tuple[tuple[Callable, Callable], ...] = ()

    @property
    def free(self) -> list[float]:
        """The first values on the whole line."""
        return [float(back(v)) for v, (_, back) in zip(self.start, self.maps)]

    def values(self, p) -> tuple:
        return tuple(f(x) for x, (f, _) in zip(p, self.maps))


_SKEW = (lambda p: np.exp(np.clip(p, -2, 2)), lambda v: math.log(v))
LAWS = {
    "norm": Law(norm),
    "std": Law(std, ("shape",), (8.0,), (_above(2.05),)),
    "sstd": Law(sstd, ("skew", "shape"), (1.05, 8.0), (_SKEW, _above(2.05))),
    "ged": Law(ged, ("shape",), (1.5,), (_above(0.2, 20.0),)),
    "sged": Law(sged, ("skew", "shape"), (1.05, 1.5), (_SKEW, _above(0.2, 20.0))),
    "nig": Law(nig, ("skew", "shape"), (0.05, 2.0), ((lambda p: 0.99 * np.tanh(p), lambda v: math.atanh(v / 0.99)), _above(0.02, 400.0))),
    "jsu": Law(jsu, ("skew", "shape"), (-0.05, 2.0), ((lambda p: 20 * np.tanh(p / 20), lambda v: 20 * math.atanh(v / 20)), _above(0.35, 60.0))),
}


@lru_cache(maxsize=256)
def _table(name: str, p: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Points and the distribution function there, by fine trapezia in asinh(10 z)."""
    y = np.linspace(-math.asinh(5e3), math.asinh(5e3), 60_001)
    x = np.sinh(y) / 10
    with np.errstate(all="ignore"):
        f = np.exp(LAWS[name].logpdf(x, *p)) * np.cosh(y) / 10
    f = np.nan_to_num(f)
    return x, np.concatenate(([0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(y))))


def cdf(name: str, z, *p: float):
    x, c = _table(name, tuple(map(float, p)))
    return np.interp(z, x, c / c[-1])


def ppf(name: str, u, *p: float):
    x, c = _table(name, tuple(map(float, p)))
    keep = np.concatenate(([True], np.diff(c) > 0))
    return np.interp(u, c[keep] / c[-1], x[keep])


def mean_abs(name: str, p: tuple) -> float:
    """E|z|."""
    x, c = _table(name, tuple(map(float, p)))
    return float((np.abs(x[1:] + x[:-1]) / 2 * np.diff(c)).sum() / c[-1])
