"""Dependence of factors: Kendall's tau, vines, and tests that a t copula is the right one."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from ..functions import vine as V
from .once import dealt, once

EDGE = "book string, tree int, a string, b string, given string, family string, rotation int, par double, par2 double, tau double, loglik double, aic double"


def taus(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(book, a, b, tau) of each pair of columns; a pair is a task's row, in n log n steps."""
    cols = sorted(columns)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sort_array(F.collect_list(F.struct("i", F.col(a).alias("x"), F.col(b).alias("y")))).alias("v")) for a, b in itertools.combinations(cols, 2)])
    d = df.groupBy(S.BOOK).agg(pairs.alias("p")).select(S.BOOK, F.inline("p"))
    d = d.select(S.BOOK, "a", "b", F.transform("v", lambda v: v["x"]).alias("x"), F.transform("v", lambda v: v["y"]).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.book, r.a, r.b, V.kendall(np.asarray(r.x, float), np.asarray(r.y, float))) for r in b.itertuples(index=False)], columns=["book", "a", "b", "tau"])

    return dealt(d, S.BOOK, "a", "b").mapInPandas(run, "book string, a string, b string, tau double")


def _matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(book, x): all values of the columns, flat, row by row in order."""
    return df.groupBy(S.BOOK).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", F.array(*columns).alias("v")))), lambda r: r["v"])).alias("x"))


def vine(df: DataFrame, columns: Sequence[str], families: Sequence[str] = tuple(V.FAMILIES)) -> DataFrame:
    """The vine of the columns' ranks, a row for each edge: its tree, the two columns, what they are given (names joined by +), the pair copula, Kendall's tau of
    the pair there, log-likelihood and AIC. The columns stand in order of their names."""
    names = sorted(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                for e in V.fit(K.pseudo(np.asarray(row.x, float).reshape(-1, len(names))), families).edges:
                    par = (*e.pair.theta, None)[:2]
                    out.append((row.book, e.tree, names[e.a], names[e.b], "+".join(names[k] for k in sorted(e.given)), e.pair.family, e.pair.rotation, *par, e.tau, e.pair.loglik, e.pair.aic))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDGE.split(", ")])

    return dealt(_matrix(df, names), S.BOOK).mapInPandas(run, EDGE)


def vine_fit(edges: DataFrame, n: DataFrame) -> DataFrame:
    """(book, n, edges, parameters, loglik, aic, bic) of vine()'s edges; n: (book, n) rows that it was fitted to."""
    k = 1 + F.col("par2").isNotNull().cast("int")
    d = edges.groupBy(S.BOOK).agg(F.count("*").alias("edges"), F.sum(k).alias("parameters"), F.sum("loglik").alias("loglik")).join(n, S.BOOK)
    return d.select(S.BOOK, "n", "edges", "parameters", "loglik", (2 * F.col("parameters") - 2 * F.col("loglik")).alias("aic"), (F.col("parameters") * F.log("n") - 2 * F.col("loglik")).alias("bic"))


def tail_dependence(u: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.01, 0.025, 0.05, 0.1, 0.2)) -> DataFrame:
    """(book, a, b, q, lower, upper): how often both columns are in the lowest (greatest) share q, over q."""
    rows = []
    for a, b in itertools.combinations(columns, 2):
        for q in at:
            low, high = (F.col(a) <= q) & (F.col(b) <= q), (F.col(a) > 1 - q) & (F.col(b) > 1 - q)
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(q).alias("q"), (F.avg(low.cast("double")) / q).alias("lower"), (F.avg(high.cast("double")) / q).alias("upper")))
    return u.groupBy(S.BOOK).agg(F.array(*rows).alias("r")).select(S.BOOK, F.inline("r"))


def rosenblatt(u: np.ndarray, r: np.ndarray, nu: float) -> np.ndarray:
    """Of rows of a t copula, independent uniforms: each column's conditional distribution given those before it."""
    x = K.t_ppf(np.clip(u, 1e-9, 1 - 1e-9), nu)
    out = np.empty_like(x)
    for j in range(x.shape[1]):
        if not j:
            out[:, 0] = K.t_cdf(x[:, 0], nu)
            continue
        inverse = np.linalg.inv(r[:j, :j])
        w = inverse @ r[:j, j]
        quad = np.einsum("ij,jk,ik->i", x[:, :j], inverse, x[:, :j])
        scale = np.sqrt((nu + quad) / (nu + j) * max(1 - r[j, :j] @ w, 1e-12))
        out[:, j] = K.t_cdf((x[:, j] - x[:, :j] @ w) / scale, nu + j)
    return out


def copula_checks(df: DataFrame, columns: Sequence[str], nu: float | None = None) -> DataFrame:
    """(book, nu, column, ks, ks_p, tau_before, pooled_ks, pooled_p): the Rosenblatt transform of the columns' ranks by their t copula. Of a true copula each column is
    uniform, has no tau with those before it, and the sum of squared normal scores is chi-squared (pooled). nu: a value to test instead of the fitted one."""
    names = list(columns)
    fields = "book string, nu double, column string, ks double, ks_p double, tau_before double, pooled_ks double, pooled_p double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                u = K.pseudo(np.asarray(row.x, float).reshape(-1, len(names)))
                if nu is None:
                    r, own, _ = K.t_copula_fit(u)
                else:
                    own, r = nu, K.t_scores_correlation(u, nu)[1]
                e = rosenblatt(u, r, own)
                total = (K.fast_norm_ppf(np.clip(e, 1e-12, 1 - 1e-12)) ** 2).sum(1)
                pooled = K.ks_against(total, lambda v: np.array([1 - K.gamma_tail(x / 2, len(names) / 2) for x in v]))
                for j, c in enumerate(names):
                    d = K.ks_against(e[:, j], lambda v: v)
                    before = max((V.kendall(e[:, k], e[:, j]) for k in range(j)), key=abs, default=0.0)
                    out.append((row.book, float(own), c, d, K.ks_p(d, len(e)), before, pooled, K.ks_p(pooled, len(e))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in fields.split(", ")])

    return dealt(_matrix(df, names), S.BOOK).mapInPandas(run, fields)


def simulation_checks(rows: DataFrame, draw, realised: DataFrame, columns: Sequence[str], block: int = 50) -> DataFrame:
    """(book, refit, column, n, ks, ks_p): for each refit, its days' realised moves as places among their day's draws, which a true model makes uniform.

    rows: days with refit and what `draw` reads; realised: (book, i, the columns). Days are dealt one by one, and only places leave the tasks.
    """
    names = list(columns)
    d = rows.join(realised.select(S.BOOK, "i", F.array(*names).alias("moves")), [S.BOOK, "i"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                x, y = draw(row), np.asarray(row.moves, float)
                place = ((x < y).sum(0) + 0.5) / (len(x) + 1)
                out += [(row.book, row.refit, row.i, c, float(p)) for c, p in zip(names, place)]
            yield pd.DataFrame(out, columns=["book", "refit", "i", "column", "place"])

    places = once(dealt(d, S.BOOK, "i").mapInPandas(run, "book string, refit int, i long, column string, place double"))
    fields = "book string, refit int, column string, n long, ks double, ks_p double"

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["place"].to_numpy(float)
        k = K.ks_against(x, lambda v: v)
        return pd.DataFrame([(pdf["book"].iloc[0], pdf["refit"].iloc[0], pdf["column"].iloc[0], len(x), k, K.ks_p(k, len(x)))], columns=[c.split()[0] for c in fields.split(", ")])

    return places.groupBy(S.BOOK, "refit", "column").applyInPandas(test, fields)
