"""Monte Carlo VaR: a task for each day (or refit) draws its scenarios, reprices the book and returns one row. Draws depend on (seed, day)
alone, so any task can be run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from ..functions import vine as V
from ..functions import volatility as G
from .book import factor_moves, pnl, values
from .once import dealt, once
from .panel import SHOCKS, frame, mc_shocks, rows

EWMA = 0.94
OUT = "book string, d date, i long, var double, mean_pnl double, std_pnl double"


def refit_days(lv: DataFrame, window: int = S.MC_WINDOW, every: int = 1) -> DataFrame:
    """(book, d, i, w): w is the window's shocks, flat, oldest first, for every `every`-th day of those with a full window."""
    shocks = mc_shocks(lv).withColumn("_w", F.collect_list(F.array(*SHOCKS)).over(frame(-window, -1))).where(F.size("_w") == window)
    return shocks.where((F.col("i") - 1 - window) % every == 0).select(S.BOOK, "d", "i", F.flatten("_w").alias("w"))


def days(lv: DataFrame, window: int = S.MC_WINDOW) -> DataFrame:
    """(book, d, i, snapshot of the day before) of the days with a full window before them."""
    snap = values(lv).select(S.BOOK, "d", F.col("i").alias("_at"), F.array(*S.ASSETS).alias("px"), F.array(*(f"sh_{c[-1]}" for c in S.ASSETS)).alias("sh"), "strike", "tenor", "vol_idx", "rate_idx")
    next_day = F.lead("d").over(Window.partitionBy(S.BOOK).orderBy("_at"))
    snap = snap.withColumns({"d": next_day, "i": F.col("_at") + 1}).where(F.col("d").isNotNull() & (F.col("i") > window)).drop("_at")
    return snap.select(S.BOOK, "d", "i", "px", "sh", "strike", "tenor", "vol_idx", "rate_idx")


def reprice_parts(row, x: np.ndarray) -> np.ndarray:
    """P&L by component (columns) of scenarios x (a column for each shock) on a snapshot; no rate is clipped and no straddle struck anew within the day."""
    px, sh = np.asarray(row.px, float), np.asarray(row.sh, float)
    moved = px * np.exp(x[:, :4])
    r0, v0 = row.rate_idx / 100, max(row.vol_idx / 100, S.MIN_VOL)
    r1, v1 = r0 + x[:, 5], np.maximum(v0 * np.exp(x[:, 4]), S.MIN_VOL)
    t1 = max(row.tenor - 1 / S.TRADING_DAYS, 1 / S.TRADING_DAYS)
    swap = K.irs(r1, S.IRS_NOTIONAL, S.IRS_FIXED) - K.irs(np.array(r0), S.IRS_NOTIONAL, S.IRS_FIXED)
    straddles = K.straddle(moved[:, 3], row.strike, t1, r1, v1) - K.straddle(px[3], row.strike, row.tenor, r0, v0)
    return np.column_stack([(moved - px) @ sh, swap, S.STRADDLE_SHARES * straddles])


def reprice(row, x: np.ndarray) -> np.ndarray:
    return reprice_parts(row, x).sum(1)


@dataclass(frozen=True)
class Model:
    """A simulation: days with what a draw reads, and a function of a day's row that draws its scenarios of the shocks."""

    rows: DataFrame
    draw: Callable

    def var(self, alpha: float = S.ALPHA) -> DataFrame:
        """(book, d, i, var, mean_pnl, std_pnl) of each day, dealt day by day."""
        draw = self.draw

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for row in b.itertuples(index=False):
                    pnl = reprice(row, draw(row))
                    out.append((row.book, row.d, row.i, -float(np.quantile(pnl, 1 - alpha)), float(pnl.mean()), float(pnl.std())))
                yield pd.DataFrame(out, columns=["book", "d", "i", "var", "mean_pnl", "std_pnl"])

        return dealt(self.rows, S.BOOK, "i").mapInPandas(run, OUT)


def gaussian_model(lv: DataFrame, window: int = S.MC_WINDOW, draws: int = 10_000, seed: int = 42) -> Model:
    """Scenarios of the window's mean and covariance (plus 1e-8 on the diagonal). These are differences of running sums, of values less the book's means, so that a
    day costs the same for any window."""
    lv, n = once(lv), len(SHOCKS)
    upper = [(a, b) for a in range(n) for b in range(a, n)]
    every, so_far = Window.partitionBy(S.BOOK), rows().rowsBetween(Window.unboundedPreceding, 0)
    d = mc_shocks(lv).select(S.BOOK, "i", *SHOCKS, *(F.avg(c).over(every).alias(f"_m{k}") for k, c in enumerate(SHOCKS)))
    d = d.select(S.BOOK, "i", *(f"_m{k}" for k in range(n)), *((F.col(c) - F.col(f"_m{k}")).alias(f"_c{k}") for k, c in enumerate(SHOCKS)))
    sums = {f"_s{k}": F.col(f"_c{k}") for k in range(n)} | {f"_p{a}_{b}": F.col(f"_c{a}") * F.col(f"_c{b}") for a, b in upper}
    d = d.select(S.BOOK, "i", *(f"_m{k}" for k in range(n)), F.array(*[F.sum(x).over(so_far) for x in sums.values()]).alias("_now"))
    zero = F.array(*[F.lit(0.0)] * len(sums))
    d = d.withColumns({"_to": F.lag("_now", 1).over(rows()), "_from": F.coalesce(F.lag("_now", window + 1).over(rows()), zero)}).where(F.col("i") > window)
    own = {k: F.col("_to")[j] - F.col("_from")[j] for j, k in enumerate(sums)}
    mean = F.array(*[F.col(f"_m{k}") + own[f"_s{k}"] / window for k in range(n)])
    cov = F.array(*[(own[f"_p{a}_{b}"] - own[f"_s{a}"] * own[f"_s{b}"] / window) / (window - 1) for a, b in upper])
    moments = d.select(S.BOOK, "i", mean.alias("mean"), cov.alias("cov"))

    def draw(row):
        cov = np.zeros((n, n))
        for (a, b), v in zip(upper, row.cov):
            cov[a, b] = cov[b, a] = v
        root = np.linalg.cholesky(cov + 1e-8 * np.eye(n))
        return np.random.default_rng([seed, row.i]).standard_normal((draws, n)) @ root.T + np.asarray(row.mean, float)

    return Model(days(lv, window).join(moments, [S.BOOK, "i"]), draw)


def gaussian(lv: DataFrame, window: int = S.MC_WINDOW, draws: int = 10_000, seed: int = 42, alpha: float = S.ALPHA) -> DataFrame:
    return gaussian_model(lv, window, draws, seed).var(alpha)


def _fitted(at: DataFrame, window: int, every: int, fit, schema: str) -> DataFrame:
    """Refit days -> (book, refit, what fit gives); refit numbers them from 0."""
    full = "book string, refit int, " + schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(row.book, row.refit, *fit(np.asarray(row.w, float).reshape(-1, len(SHOCKS)), row.i)) for row in b.itertuples(index=False)], columns=[x.split()[0] for x in full.split(", ")])

    at = at.withColumn("refit", refit_of(window, every)).select(S.BOOK, "refit", "i", "w")
    return dealt(at, S.BOOK, "refit").mapInPandas(run, full)


def refit_of(window: int, every: int):
    """The number of the last refit day up to a row's."""
    return ((F.col("i") - 1 - window) / every).cast("int")


def t_copula_model(lv: DataFrame, window: int = S.MC_WINDOW, every: int = 50, draws: int = 10_000, seed: int = 42) -> Model:
    """Student-t marginals joined by a t copula, refitted every `every` days."""
    lv, n = once(lv), len(SHOCKS)

    def fit(w, i):
        marginals = [K.t_fit(w[:, j]) for j in range(w.shape[1])]
        r, nu, _ = K.t_copula_fit(K.pseudo(w))
        return np.array(marginals).ravel().tolist(), r.ravel().tolist(), float(nu)

    def draw(row):
        u = K.t_copula_sample(np.array(row.corr).reshape(n, n), row.nu, draws, np.random.default_rng([seed, row.i]))
        return np.stack([m[1] + m[2] * K.t_ppf(u[:, j], m[0]) for j, m in enumerate(np.array(row.marginals).reshape(n, 3))], 1)

    fits = _fitted(refit_days(lv, window, every), window, every, fit, "marginals array<double>, corr array<double>, nu double")
    return Model(days(lv, window).withColumn("refit", refit_of(window, every)).join(fits, [S.BOOK, "refit"]), draw)


def t_copula(lv: DataFrame, window: int = S.MC_WINDOW, every: int = 50, draws: int = 10_000, seed: int = 42, alpha: float = S.ALPHA) -> DataFrame:
    return t_copula_model(lv, window, every, draws, seed).var(alpha)


def garch_fits(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standardised residuals and (mu, omega, alpha, beta, nu, last sigma) of each column's GARCH; persistence is held under 0.9999."""
    z, params = np.empty(w.shape), []
    for j in range(w.shape[1]):
        scale = 1 / (w[:, j].std() or 1.0)
        f = K.garch_fit(w[:, j] * scale)
        ab = f["alpha"] + f["beta"]
        shrink = min(1.0, 0.9999 / ab) if ab >= 1 else 1.0
        z[:, j] = (w[:, j] * scale - f["mu"]) / f["sigma"]
        params.append((f["mu"] / scale, f["omega"] / scale**2, f["alpha"] * shrink, f["beta"] * shrink, max(f["nu"], 2.1), f["sigma"][-1] / scale))
    return z, np.array(params)


def _ewma(q: np.ndarray, z: np.ndarray, lam: float) -> np.ndarray:
    return lam * q + (1 - lam) * np.outer(z, z)


def garch_copula_fits(lv: DataFrame, window: int = S.MC_WINDOW, every: int = 50, at: DataFrame | None = None) -> DataFrame:
    """(book, refit, params, q, nu, start): GARCH marginals, a t copula of their residuals and their EWMA covariance, for every `every`-th day, or the days of `at`."""

    def fit(w, i):
        z, params = garch_fits(w)
        _, nu, _ = K.t_copula_fit(K.pseudo(z))
        q = np.cov(z.T) + 1e-8 * np.eye(w.shape[1])
        for row in z:
            q = _ewma(q, row, EWMA)
        return params.ravel().tolist(), q.ravel().tolist(), float(nu), i

    return _fitted(refit_days(lv, window, every) if at is None else at, window, every, fit, "params array<double>, q array<double>, nu double, start long")


def garch_copula_model(lv: DataFrame, fits: DataFrame, window: int = S.MC_WINDOW, every: int = 50, draws: int = 10_000, seed: int = 42, again: bool = True) -> Model:
    """A day's state is folded from its refit's over the days between, at most `every` of them: an EWMA correlation goes on from the refit day by day. again:
    the last residual of the warm-up enters the correlation a second time, as in the model that this follows."""
    n = len(SHOCKS)
    past = mc_shocks(lv).select(S.BOOK, "i", F.flatten(F.collect_list(F.array(*SHOCKS)).over(frame(-every, -1))).alias("past"))

    def draw(row):
        p, q = np.array(row.params).reshape(n, 6), np.array(row.q).reshape(n, n)
        mu, omega, a, b, nus, sigma = p.T
        for k, r in enumerate(np.asarray(row.past, float).reshape(-1, n)[-(row.i - row.start) - 1 :]):
            x = r - mu
            if k or again:
                q = _ewma(q, x / np.maximum(sigma, 1e-8), EWMA)
            sigma = np.sqrt(np.maximum(omega + a * x * x + b * sigma**2, 1e-12))
        dev = np.sqrt(np.diag(q))
        u = K.t_copula_sample(K.nearest_pd(q / np.outer(dev, dev)), row.nu, draws, np.random.default_rng([seed, row.i]))
        return np.stack([mu[j] + sigma[j] * K.t_ppf(u[:, j], nus[j]) * np.sqrt((nus[j] - 2) / nus[j]) for j in range(n)], 1)

    rows = days(lv, window).withColumn("refit", refit_of(window, every)).join(fits, [S.BOOK, "refit"])
    return Model(rows.join(past, [S.BOOK, "i"]), draw)


def garch_copula(lv: DataFrame, window: int = S.MC_WINDOW, every: int = 50, draws: int = 10_000, seed: int = 42, alpha: float = S.ALPHA) -> DataFrame:
    """GARCH marginals, a t copula of their residuals, and an EWMA correlation."""
    lv = once(lv)
    return garch_copula_model(lv, garch_copula_fits(lv, window, every), window, every, draws, seed).var(alpha)


def refit_sweep(lv: DataFrame, every=(10, 25, 50), window: int = S.MC_WINDOW, draws: int = 10_000, seed: int = 42) -> tuple[dict[int, DataFrame], DataFrame]:
    """({frequency: garch_copula's rows}, fits): the model refitted at several frequencies. A day that several of them refit on is fitted once; each frequency
    takes its own of the fits, whose `refit` is the day's distance from the first."""
    lv = once(lv)
    at = refit_days(lv, window)
    at = at.where(reduce(or_, [(F.col("i") - 1 - window) % n == 0 for n in every]))
    fits = once(garch_copula_fits(lv, window, 1, at))
    own = lambda n: fits.where(F.col("refit") % n == 0).withColumn("refit", (F.col("refit") / n).cast("int"))
    return {n: garch_copula_model(lv, own(n), window, n, draws, seed).var() for n in every}, fits


#: The factors whose moves book.factor_pnl takes.
MOVES = ("d_log", "b_log", "a_log", "rate_chg", "vol_chg")


def by_moves(row, x: np.ndarray) -> np.ndarray:
    """book.factor_pnl of simulated moves x (a column for each of MOVES) on a row's state."""
    r1, v1 = row.r + x[:, 3] / 100, np.maximum((row.v + x[:, 4]) / 100, S.MIN_VOL)
    straddles = K.straddle(row.spot * np.exp(x[:, 0]), row.k, row.t, r1, v1) - K.straddle(row.spot, row.k, row.t, row.r, max(row.v / 100, S.MIN_VOL))
    swap = K.irs(r1, S.IRS_NOTIONAL, S.IRS_FIXED) - K.irs(np.array(row.r), S.IRS_NOTIONAL, S.IRS_FIXED)
    return S.V0 * S.WEIGHT * x[:, :3].sum(1) + swap + S.STRADDLE_SHARES * straddles


def factor_var(lv: DataFrame, models: DataFrame, window: int = 250, every: int = 50, draws: int = 5_000, seed: int = 42, levels=(0.95, 0.99)) -> DataFrame:
    """(book, d, i, refit, var_95, var_99, realised_pnl, exception_95, exception_99): filtered simulation of factor moves.

    Each factor has the mean, volatility model and law that `models` (book, factor, model, law, p, q) names, refitted every `every` days; a vine copula joins the
    residuals, and draws are quantiles of the residuals themselves (median-unbiased), brought to mean 0 and deviation 1. Forecast means stay between refits; each
    day's volatility follows from the day before's by the model's own recursion, that of the exponential model too.
    """
    n = len(MOVES)
    of = lambda c: F.array(*[F.max(F.when(F.col("factor") == m, F.col(c))) for m in MOVES]).alias(c)
    models = models.groupBy(S.BOOK).agg(*map(of, ("model", "law", "p", "q")))
    lv = once(lv)
    moves = factor_moves(lv)
    d = moves.drop(*MOVES).where(F.col("i") > window).withColumn("refit", refit_of(window, every))
    past = moves.select(S.BOOK, "i", F.flatten(F.collect_list(F.array(*MOVES)).over(frame(-every, -1))).alias("past"))
    at = moves.withColumn("_w", F.collect_list(F.array(*MOVES)).over(frame(-window, -1))).where((F.size("_w") == window) & ((F.col("i") - 1 - window) % every == 0))
    at = at.select(S.BOOK, refit_of(window, every).alias("refit"), "i", F.flatten("_w").alias("w")).join(models, S.BOOK)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                w = np.asarray(row.w, float).reshape(-1, n)
                z, params = np.empty(w.shape), []
                for j in range(n):
                    scale = 1 / (w[:, j].std() or 1.0)
                    r = w[:, j] * scale
                    f = G.fit(r, row.model[j], [row.law[j]], (int(row.p[j]), int(row.q[j])), rounds=40)[0]
                    z[:, j] = f["z"]
                    params += [scale, G.MODELS.index(row.model[j]), G.mean_of_next(f, r), f["next"], *(f[k] for k in ("omega", "alpha", "beta", "gamma", "delta", "mean_abs"))]
                out.append((row.book, row.refit, row.i, params, z.ravel().tolist(), V.packed(V.fit(K.pseudo(z)))))
            yield pd.DataFrame(out, columns=["book", "refit", "start", "params", "z", "vine"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                z, mu, sigma = np.asarray(row.z, float).reshape(-1, n), np.empty(n), np.empty(n)
                days_on = row.i - row.start
                between = np.asarray(row.past, float).reshape(-1, n)[-days_on:] if days_on else np.empty((0, n))
                for j, p in enumerate(np.asarray(row.params, float).reshape(n, -1).tolist()):
                    scale, model, m, s, *rest = p
                    for r in between[:, j].tolist():
                        s = G.variance_step(G.MODELS[int(model)], s, r * scale - m, *rest)
                    mu[j], sigma[j] = m / scale, np.sqrt(s) / scale
                u = V.unpacked(n, row.vine).sample(draws, np.random.default_rng([seed, row.i]))
                q = np.stack([np.quantile(z[:, j], u[:, j], method="median_unbiased") for j in range(n)], 1)
                pnl = by_moves(row, mu + sigma * (q - q.mean(0)) / q.std(0, ddof=1))
                out.append((row.book, row.d, row.i, row.refit, *(-float(np.quantile(pnl, 1 - a)) for a in levels)))
            yield pd.DataFrame(out, columns=["book", "d", "i", "refit", *names])

    names = [f"var_{100 * a:g}" for a in levels]
    fits = dealt(at, S.BOOK, "refit").mapInPandas(fit, "book string, refit int, start long, params array<double>, z array<double>, vine array<double>")
    d = d.join(fits, [S.BOOK, "refit"]).join(past, [S.BOOK, "i"])
    rows = dealt(d, S.BOOK, "i").mapInPandas(run, "book string, d date, i long, refit int, " + ", ".join(f"{c} double" for c in names))
    rows = rows.join(pnl(lv).select(S.BOOK, "i", F.col("pnl_total").alias("realised_pnl")), [S.BOOK, "i"])
    return rows.withColumns({c.replace("var", "exception"): (-F.col("realised_pnl") > F.col(c)) for c in names})


def copula_gof(lv: DataFrame, window: int = S.MC_WINDOW, every: int = 500, replicates: int = 200, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(book, d, i, nu, cvm, p, replicates): parametric bootstrap of the Cramer-von Mises distance of the residuals' t copula, for the first window
    and each `every` days on (every tenth refit). The copula is fitted once a window; a task for each replicate (0 is the sample's own), which
    keeps nu and estimates the correlation anew."""
    n = len(SHOCKS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                u = K.pseudo(garch_fits(np.asarray(row.w, float).reshape(-1, n))[0])
                r, nu, _ = K.t_copula_fit(u)
                out.append((row.book, row.d, row.i, u.ravel().tolist(), r.ravel().tolist(), float(nu)))
            yield pd.DataFrame(out, columns=["book", "d", "i", "u", "r", "nu"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                u, r = np.asarray(row.u, float).reshape(-1, n), np.asarray(row.r, float).reshape(n, n)
                if row.replicate:
                    u = K.t_copula_sample(K.nearest_pd(r), row.nu, len(u), np.random.default_rng([seed, row.i, row.replicate]))
                    r = K.t_scores_correlation(u, row.nu)[1]
                out.append((row.book, row.d, row.i, row.replicate, row.nu, K.cvm(u, r, row.nu, seed, draws)))
            yield pd.DataFrame(out, columns=["book", "d", "i", "replicate", "nu", "cvm"])

    fits = once(dealt(refit_days(lv, window, every), S.BOOK, "i").mapInPandas(fit, "book string, d date, i long, u array<double>, r array<double>, nu double"))
    s = dealt(fits.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))), S.BOOK, "i", "replicate")
    s = once(s.mapInPandas(run, "book string, d date, i long, replicate int, nu double, cvm double"))
    own = s.where("replicate = 0").select(S.BOOK, "i", F.col("cvm").alias("own"))
    g = s.where("replicate > 0").join(own, [S.BOOK, "i"]).groupBy(S.BOOK, "d", "i", "nu")
    return g.agg(F.first("own").alias("cvm"), F.avg((F.col("cvm") >= F.col("own")).cast("double")).alias("p"), F.count("*").alias("replicates"))
