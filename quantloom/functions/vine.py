"""Regular vine copulas: pair copulas of six families with rotations, trees of greatest dependence, likelihood and simulation, in numpy.

A vine takes the joint law of d variables apart into d (d - 1) / 2 pair copulas. The first tree joins the variables; each later one joins edges of the tree before
that share a node, and its pairs are of two variables given those that both edges have.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from . import kernels as K

EPS = 1e-10
GOLDEN = (math.sqrt(5) - 1) / 2
#: Degrees of freedom that are tried for a t pair.
NUS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 50)


def inversions(r: np.ndarray) -> int:
    """Pairs i < j with r[i] > r[j], of whole numbers from 0: bit by bit, within runs that agree in the higher bits."""
    r, total = np.asarray(r, np.int64), 0
    for b in reversed(range(max(1, int(r.max(initial=0)).bit_length()))):
        head, bit = r >> (b + 1), (r >> b) & 1
        ones = np.cumsum(bit)
        starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(r) else np.zeros(0, np.int64)
        base = np.repeat(ones[starts] - bit[starts], np.diff(np.append(starts, len(r))))
        total += int((ones - base)[bit == 0].sum())
        r = r[np.argsort(r >> b, kind="stable")]
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b, in n log n steps; 0 where a column is constant."""
    n = len(x)
    cx, cy = (np.unique(v, return_inverse=True, return_counts=True)[1:] for v in (x, y))
    both = np.unique(np.stack((cx[0], cy[0])), axis=1, return_counts=True)[1]
    pairs = lambda counts: int((counts * (counts - 1) // 2).sum())
    n0, n1, n2 = n * (n - 1) // 2, pairs(cx[1]), pairs(cy[1])
    order = np.lexsort((cy[0], cx[0]))
    same = n0 - n1 - n2 + pairs(both) - 2 * inversions(cy[0][order])
    return same / math.sqrt((n0 - n1) * (n0 - n2)) if n0 > n1 and n0 > n2 else 0.0


# --- pair copulas: log density c(u, v), h(u | v), and the u of a given h ----------------------------------------------------------------


def _normal(u, v, r):
    x, y = K.fast_norm_ppf(u), K.fast_norm_ppf(v)
    return -0.5 * math.log(1 - r * r) - (r * r * (x * x + y * y) - 2 * r * x * y) / (2 * (1 - r * r))


def _normal_h(u, v, r):
    return K.fast_norm_cdf((K.fast_norm_ppf(u) - r * K.fast_norm_ppf(v)) / math.sqrt(1 - r * r))


def _normal_inverse(p, v, r):
    return K.fast_norm_cdf(K.fast_norm_ppf(p) * math.sqrt(1 - r * r) + r * K.fast_norm_ppf(v))


def _t(u, v, r, nu):
    x, y = K.t_ppf(u, nu), K.t_ppf(v, nu)
    joint = -math.log(2 * math.pi) - 0.5 * math.log(1 - r * r) - (nu + 2) / 2 * np.log1p((x * x + y * y - 2 * r * x * y) / (nu * (1 - r * r)))
    return joint - K.t_logpdf(x, nu) - K.t_logpdf(y, nu)


def _t_h(u, v, r, nu):
    y = K.t_ppf(v, nu)
    return K.t_cdf((K.t_ppf(u, nu) - r * y) / np.sqrt((nu + y * y) * (1 - r * r) / (nu + 1)), nu + 1)


def _t_inverse(p, v, r, nu):
    y = K.t_ppf(v, nu)
    return K.t_cdf(K.t_ppf(p, nu + 1) * np.sqrt((nu + y * y) * (1 - r * r) / (nu + 1)) + r * y, nu)


def _clayton(u, v, a):
    x, y = -a * np.log(u), -a * np.log(v)
    # ln(u^-a + v^-a - 1), without overflow
    top = np.maximum(x, y)
    s = top + np.log(np.exp(x - top) + np.exp(y - top) - np.exp(-top))
    return math.log1p(a) - (1 + a) * (np.log(u) + np.log(v)) - (2 + 1 / a) * s


def _clayton_h(u, v, a):
    x, y = -a * np.log(u), -a * np.log(v)
    top = np.maximum(x, y)
    s = top + np.log(np.exp(x - top) + np.exp(y - top) - np.exp(-top))
    return np.exp((1 + 1 / a) * (y - s))


def _clayton_inverse(p, v, a):
    # u^-a = 1 + v^-a (p^(-a / (1 + a)) - 1)
    x = -a * np.log(v) + np.log(np.maximum(np.expm1(-a / (1 + a) * np.log(p)), 1e-300))
    return np.exp(-np.logaddexp(0, x) / a)


def _gumbel(u, v, a):
    lx, ly = np.log(-np.log(u)), np.log(-np.log(v))
    ls = np.logaddexp(a * lx, a * ly)
    root = np.exp(ls / a)
    return -root + np.exp(lx) + np.exp(ly) + (a - 1) * (lx + ly) + (2 / a - 2) * ls + np.log1p((a - 1) / root)


def _gumbel_h(u, v, a):
    lx, ly = np.log(-np.log(u)), np.log(-np.log(v))
    ls = np.logaddexp(a * lx, a * ly)
    return np.exp(-np.exp(ls / a) + np.exp(ly) + (a - 1) * ly + (1 / a - 1) * ls)


def _frank(u, v, a):
    g, x, y = -math.expm1(-a), -np.expm1(-a * u), -np.expm1(-a * v)
    return math.log(a * g) - a * (u + v) - 2 * np.log(np.abs(g - x * y))


def _frank_h(u, v, a):
    g, x, y = -math.expm1(-a), -np.expm1(-a * u), -np.expm1(-a * v)
    return (1 - y) * x / (g - x * y)


def _frank_inverse(p, v, a):
    g, y = -math.expm1(-a), -np.expm1(-a * v)
    return -np.log1p(-p * g / (1 - y * (1 - p))) / a


def _joe(u, v, a):
    x, y = np.log1p(-u), np.log1p(-v)
    s = np.exp(a * x) + np.exp(a * y) * -np.expm1(a * x)
    return (1 / a - 2) * np.log(s) + (a - 1) * (x + y) + np.log(a - 1 + s)


def _joe_h(u, v, a):
    x, y = np.log1p(-u), np.log1p(-v)
    rest = -np.expm1(a * x)
    return np.exp((a - 1) * y + (1 / a - 1) * np.log(np.exp(a * x) + np.exp(a * y) * rest)) * rest


@dataclass(frozen=True)
class Family:
    density: Callable
    h: Callable
    inverse: Callable | None
    low: float  # bounds of the parameter
    high: float
    turns: bool  # has rotations: it stands for dependence of one sign and one tail


#: The six families; what a pair may be.
FAMILIES = {
    "gaussian": Family(_normal, _normal_h, _normal_inverse, -0.999, 0.999, False),
    "t": Family(_t, _t_h, _t_inverse, -0.999, 0.999, False),
    "clayton": Family(_clayton, _clayton_h, _clayton_inverse, 1e-3, 28.0, True),
    "gumbel": Family(_gumbel, _gumbel_h, None, 1.0 + 1e-4, 50.0, True),
    "frank": Family(_frank, _frank_h, _frank_inverse, -35.0, 35.0, False),
    "joe": Family(_joe, _joe_h, None, 1.0 + 1e-4, 30.0, True),
}


def _solve(h, p, v, steps: int = 60):
    """u with h(u, v) = p, for h that grows in u: false position that halves the side that stays."""
    a, b = np.full_like(p, EPS), np.full_like(p, 1 - EPS)
    fa, fb = h(a, v) - p, h(b, v) - p
    side = np.zeros(len(p), np.int8)
    m = np.clip(p, EPS, 1 - EPS)
    for _ in range(steps):
        fm = h(m, v) - p
        up = fm > 0
        fa = np.where(up & (side == 1), fa / 2, np.where(up, fa, fm))
        fb = np.where(~up & (side == -1), fb / 2, np.where(up, fm, fb))
        a, b, side = np.where(up, a, m), np.where(up, m, b), np.where(up, 1, -1)
        if max(np.abs(fm).max(initial=0), 0) < 1e-11 or (b - a).max(initial=0) < 1e-12:
            break
        gap = fb - fa
        m = np.where(gap > 0, a - fa * (b - a) / np.where(gap > 0, gap, 1), (a + b) / 2)
        m = np.where((m > a) & (m < b), m, (a + b) / 2)
    return m


@dataclass(frozen=True)
class Pair:
    """A pair copula: its family, rotation (0, 90: u turned, 180: both, 270: v turned) and parameters."""

    family: str
    rotation: int
    theta: tuple[float, ...]
    loglik: float = 0.0

    @property
    def aic(self) -> float:
        return 2 * len(self.theta) - 2 * self.loglik

    def _turned(self, u, v):
        return 1 - u if self.rotation in (90, 180) else u, 1 - v if self.rotation in (180, 270) else v

    def logpdf(self, u, v):
        a, b = self._turned(_inside(u), _inside(v))
        return FAMILIES[self.family].density(a, b, *self.theta)

    def h(self, u, v):
        """P(U <= u | V = v)."""
        a, b = self._turned(_inside(u), _inside(v))
        p = FAMILIES[self.family].h(a, b, *self.theta)
        return _inside(1 - p if self.rotation in (90, 180) else p)

    def h_other(self, u, v):
        """P(V <= v | U = u): all families are symmetric before they are turned."""
        a, b = self._turned(_inside(u), _inside(v))
        p = FAMILIES[self.family].h(b, a, *self.theta)
        return _inside(1 - p if self.rotation in (180, 270) else p)

    def _inverse(self, p, b):
        f = FAMILIES[self.family]
        return f.inverse(p, b, *self.theta) if f.inverse else _solve(lambda x, y: f.h(x, y, *self.theta), p, b)

    def inverse(self, p, v):
        """The u with h(u, v) = p."""
        b = self._turned(p, _inside(v))[1]
        p = _inside(1 - p if self.rotation in (90, 180) else p)
        u = _inside(self._inverse(p, b))
        return 1 - u if self.rotation in (90, 180) else u

    def inverse_other(self, p, u):
        """The v with h_other(u, v) = p."""
        a = self._turned(_inside(u), p)[0]
        p = _inside(1 - p if self.rotation in (180, 270) else p)
        v = _inside(self._inverse(p, a))
        return 1 - v if self.rotation in (180, 270) else v


def _inside(u):
    return np.clip(u, EPS, 1 - EPS)


def _peak(f, low: float, high: float, steps: int = 34) -> tuple[float, float]:
    """(x, f(x)) of the greatest value of a function with one peak."""
    a, b = low, high
    x, y = b - GOLDEN * (b - a), a + GOLDEN * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx > fy:
            b, y, fy = y, x, fx
            x = b - GOLDEN * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + GOLDEN * (b - a)
            fy = f(y)
    return (x, fx) if fx > fy else (y, fy)


def fit_pair(u: np.ndarray, v: np.ndarray, families: Sequence[str] = tuple(FAMILIES), tau: float | None = None) -> Pair:
    """The pair copula of least AIC. Families of one tail are tried in the two rotations that have the sign of Kendall's tau."""
    u, v = _inside(u), _inside(v)
    tau = kendall(u, v) if tau is None else tau
    best = None
    near = math.sin(math.pi / 2 * max(-0.98, min(0.98, tau)))
    with np.errstate(all="ignore"):
        for name in families:
            f = FAMILIES[name]
            for rotation in ((0, 180) if tau >= 0 else (90, 270)) if f.turns else (0,):
                a, b = Pair(name, rotation, ())._turned(u, v)
                if name == "t":
                    x = {}
                    for nu in NUS:
                        r, ll = _peak(lambda r, nu=nu: _finite(_t(a, b, r, nu)), max(-0.995, near - 0.25), min(0.995, near + 0.25), 14)
                        x[nu] = (ll, (r, float(nu)))
                    ll, theta = max(x.values())
                else:
                    low, high = f.low, f.high
                    if name == "gaussian":
                        low, high = max(low, near - 0.3), min(high, near + 0.3)
                    elif name == "frank":
                        low, high = (1e-4, high) if tau >= 0 else (low, -1e-4)
                    scale = np.log if f.turns else float
                    back = math.exp if f.turns else float
                    z, ll = _peak(lambda z: _finite(f.density(a, b, back(z))), float(scale(low)), float(scale(high)))
                    theta = (back(z),)
                pair = Pair(name, rotation, tuple(map(float, theta)), float(ll))
                if math.isfinite(ll) and (best is None or pair.aic < best.aic):
                    best = pair
    return best or Pair("gaussian", 0, (0.0,), 0.0)


def _finite(ll: np.ndarray) -> float:
    s = float(ll.sum())
    return s if math.isfinite(s) else -math.inf


# --- vines --------------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Edge:
    """A pair of variables a, b given others, in a tree from 1 on."""

    tree: int
    a: int
    b: int
    given: frozenset
    pair: Pair
    tau: float

    @property
    def whole(self) -> frozenset:
        return self.given | {self.a, self.b}


def spanning_tree(nodes: int, weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Edges (i, j), i < j, of a spanning tree of greatest weight; of equal weights the first pair."""
    joined, out = {0}, []
    while len(joined) < nodes:
        i, j = max(((i, j) for i, j in weights if (i in joined) != (j in joined)), key=lambda e: (weights[e], (-e[0], -e[1])))
        joined |= {i, j}
        out.append((i, j))
    return sorted(out)


class Vine:
    """Edges tree by tree; what a variable is conditioned on names its values."""

    def __init__(self, d: int, edges: Sequence[Edge]):
        self.d, self.edges = d, tuple(edges)

    @property
    def loglik(self) -> float:
        return sum(e.pair.loglik for e in self.edges)

    @property
    def parameters(self) -> int:
        return sum(len(e.pair.theta) for e in self.edges)

    def logpdf(self, u: np.ndarray) -> np.ndarray:
        """Each row's log density."""
        at = {(k, frozenset()): _inside(u[:, k]) for k in range(self.d)}
        out = np.zeros(len(u))
        for e in self.edges:
            x, y = at[e.a, e.given], at[e.b, e.given]
            out += e.pair.logpdf(x, y)
            at[e.a, e.given | {e.b}] = e.pair.h(x, y)
            at[e.b, e.given | {e.a}] = e.pair.h_other(x, y)
        return out

    def order(self) -> list[tuple[int, list[Edge]]]:
        """Variables as they are drawn, each with the edges that tie it to those before it, by tree."""
        left, out, known = list(self.edges), [], set(range(self.d))
        while left:
            a = max(left, key=lambda e: e.tree).a
            own = sorted((e for e in left if a in (e.a, e.b)), key=lambda e: e.tree)
            out.append((a, own))
            left = [e for e in left if a not in (e.a, e.b)]
            known.discard(a)
        out += [(k, []) for k in sorted(known)]
        return out[::-1]

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """n rows of uniforms: each variable through the inverses of its edges, from the last tree to the first."""
        at: dict = {}
        u = np.empty((n, self.d))
        w = rng.random((n, self.d))
        with np.errstate(all="ignore"):
            for a, edges in self.order():
                p = _inside(w[:, a])
                for e in reversed(edges):
                    at[a, e.whole - {a}] = p
                    p = e.pair.inverse(p, at[e.b, e.given]) if e.a == a else e.pair.inverse_other(p, at[e.a, e.given])
                at[a, frozenset()] = u[:, a] = p
                for e in edges:
                    x, y = (at[e.a, e.given], at[e.b, e.given])
                    if e.a == a:
                        at[e.b, e.given | {a}] = e.pair.h_other(x, y)
                    else:
                        at[e.a, e.given | {a}] = e.pair.h(x, y)
        return u


def fit(u: np.ndarray, families: Sequence[str] = tuple(FAMILIES)) -> Vine:
    """The vine of pseudo-observations u: each tree spans with the greatest sum of |tau|, each pair has the family of least AIC."""
    d = u.shape[1]
    at = {(k, frozenset()): _inside(u[:, k]) for k in range(d)}
    nodes: list = [(frozenset({k}), (k,)) for k in range(d)]  # what a node spans, and its children
    edges: list[Edge] = []
    for tree in range(1, d):
        taus = {}
        for i in range(len(nodes)):
            for j in range(i + 1, len(nodes)):
                (s, c), (t, e) = nodes[i], nodes[j]
                if tree > 1 and not set(c) & set(e):
                    continue
                given = s & t
                (a,), (b,) = s - given, t - given
                taus[i, j] = (kendall(at[a, given], at[b, given]), a, b, given)
        chosen = spanning_tree(len(nodes), {k: abs(v[0]) for k, v in taus.items()})
        after = []
        for i, j in chosen:
            tau, a, b, given = taus[i, j]
            a, b = min(a, b), max(a, b)
            pair = fit_pair(at[a, given], at[b, given], families, tau)
            at[a, given | {b}] = pair.h(at[a, given], at[b, given])
            at[b, given | {a}] = pair.h_other(at[a, given], at[b, given])
            edges.append(Edge(tree, a, b, given, pair, tau))
            after.append((nodes[i][0] | nodes[j][0], (i, j)))
        nodes = after
    return Vine(d, edges)


def packed(vine: Vine) -> list[float]:
    """A vine as numbers, for a column: six for each edge, and what it is given as bits."""
    names = list(FAMILIES)
    out: list[float] = []
    for e in vine.edges:
        theta = (*e.pair.theta, 0.0)[:2]
        out += [e.tree, e.a, e.b, sum(1 << k for k in e.given), names.index(e.pair.family), e.pair.rotation, len(e.pair.theta), *theta, e.pair.loglik, e.tau]
    return [float(x) for x in out]


def unpacked(d: int, values: Sequence[float]) -> Vine:
    names, edges = list(FAMILIES), []
    for tree, a, b, bits, family, rotation, k, t1, t2, ll, tau in np.asarray(values, float).reshape(-1, 11).tolist():
        given = frozenset(i for i in range(d) if int(bits) >> i & 1)
        edges.append(Edge(int(tree), int(a), int(b), given, Pair(names[int(family)], int(rotation), (t1, t2)[: int(k)], ll), tau))
    return Vine(d, edges)
