"""Models of each factor: ARMA orders, every volatility model with every law, the choice among them and the criteria it is judged by, as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import arma, families, laws
from ..functions import kernels as K
from ..functions import volatility as G
from . import diagnostics
from .once import dealt, once

#: 5% points of Nyblom's joint statistic for 1, 2, 3 ... parameters.
NYBLOM_5 = (0.470, 0.749, 1.01, 1.24, 1.47, 1.68, 1.90, 2.11, 2.32, 2.54, 2.75, 2.96, 3.15, 3.34, 3.54, 3.75, 3.95, 4.14, 4.33, 4.52)
#: Groups of the Pearson tests of a residuals' law, and the p that all of them must exceed.
GROUPS, GATE = (20, 30, 40, 50), 0.05
ORDER = "p int, q int"
FIT = (
    "book string, factor string, model string, law string, p int, q int, n long, mu double, omega double, alpha double, beta double, gamma double, delta double, skew double, shape double, "
    "ar array<double>, ma array<double>, loglik double, parameters int, aic double, bic double, gof_min double, gof_mean double, gof_share double, variance double, long_run double, "
    "persistence double, nyblom double, z array<double>"
)


def long_series(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(book, factor, x): each column's values in order, as one array."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in columns]))
    return df.select(S.BOOK, "i", rows).groupBy(S.BOOK, "factor").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("x"))


def arma_orders(df: DataFrame, columns: Sequence[str], most: int = 5) -> DataFrame:
    """(book, factor, rank, p, q, mu, variance, loglik, aic, ar, ma, lb_p) of every order up to `most`, by AIC; lb_p is the Ljung-Box test of the residuals, ten lags
    less the order. All orders are searched; a factor is a task."""
    fields = "book string, factor string, rank int, p int, q int, mu double, variance double, loglik double, aic double, ar array<double>, ma array<double>, lb_p double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                x = np.asarray(row.x, float)
                for k, f in enumerate(arma.best(x, most), 1):
                    e = G.residuals(x, np.array([f["mu"]]), np.array(f["ar"])[:, None], np.array(f["ma"])[:, None])[:, 0]
                    lb = K.gamma_tail(K.ljung_box(e, 10) / 2, (10 - f["p"] - f["q"]) / 2) if f["p"] + f["q"] < 10 else None
                    out.append((row.book, row.factor, k, f["p"], f["q"], f["mu"], f["variance"], f["loglik"], f["aic"], f["ar"], f["ma"], lb))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in fields.split(", ")])

    return dealt(long_series(df, columns), S.BOOK, "factor").mapInPandas(run, fields)


def fits(df: DataFrame, columns: Sequence[str], models: Sequence[str] = G.MODELS, names: Sequence[str] = tuple(laws.LAWS), orders: DataFrame | None = None) -> DataFrame:
    """A row of FIT for each book, column, model and law, by maximum likelihood over all history. orders: (book, factor, p, q) of the mean; without them it is
    constant. gof_*: Pearson's tests that the residuals z follow the law. A fit that doesn't end at a finite likelihood has no row.

    A task has one model of one factor: its laws share the recursion's loop.
    """
    d = long_series(df, columns)
    d = d.join(orders.select(S.BOOK, "factor", "p", "q"), [S.BOOK, "factor"]) if orders is not None else d.withColumns({"p": F.lit(0), "q": F.lit(0)})
    d = d.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    names = tuple(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for row in b.itertuples(index=False) for r in _rows(row, names)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIT.split(", ")])

    return dealt(d, S.BOOK, "factor", "model").mapInPandas(run, FIT)


def _rows(row, names: tuple[str, ...]) -> Iterator[tuple]:
    x = np.asarray(row.x, float)
    scale = 1 / (x.std() or 1.0)
    r = x * scale
    for f in G.fit(r, row.model, names, (int(row.p), int(row.q))):
        if not np.isfinite(f["loglik"]):
            continue
        loglik, k, n = f["loglik"] + len(x) * float(np.log(scale)), f["k"], len(x)
        ps = G.gof(f, GROUPS)
        omega = f["omega"] + (1 - f["beta"]) * -2 * float(np.log(scale)) if row.model == "egarch" else f["omega"] / scale ** f["delta"]
        p = dict(zip(laws.LAWS[f["law"]].names, f["law_p"]))
        level = G.long_run(f)
        yield (
            row.book, row.factor, row.model, f["law"], row.p, row.q, n, f["mu"] / scale, omega, f["alpha"], f["beta"], f["gamma"], f["delta"], p.get("skew"), p.get("shape"), f["ar"], f["ma"], loglik, k,
            2 * k - 2 * loglik, k * float(np.log(n)) - 2 * loglik, min(ps), float(np.mean(ps)), float(np.mean([v > GATE for v in ps])), float(x.var(ddof=1)),
            None if level is None else level / scale**2, G.persistence(f), G.nyblom(f, r), f["z"].tolist(),
        )


def selected(all_fits: DataFrame) -> DataFrame:
    """Of each factor's fits the one of least AIC whose residuals pass all Pearson tests; the one of least AIC if none does. passed tells which."""
    d = all_fits.withColumn("passed", F.col("gof_min") > GATE)
    w = Window.partitionBy(S.BOOK, "factor").orderBy(F.desc("passed"), "aic", "model", "law")
    return d.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def candidates(all_fits: DataFrame, top: int = 3) -> DataFrame:
    """Each factor's `top` fits by AIC, as a report."""
    w = Window.partitionBy(S.BOOK, "factor").orderBy("aic", "model", "law")
    return all_fits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(S.BOOK, "factor", "rank", "model", "law", "aic", "bic", "gof_min", "gof_mean", (F.col("gof_min") > GATE).alias("passed"))


def _weighted_p(df: DataFrame, q: str, lags: int, fitted: str) -> DataFrame:
    """df with p, the weighted portmanteau's tail of column q less the `fitted` parameters; where the gamma law has no moments, that of column plain."""
    fields = ", ".join(f"{c} {k}" for c, k in df.dtypes) + ", p double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ps = []
            for x, plain, k in zip(b[q], b["plain"], b[fitted]):
                p = K.weighted_tail(x, lags, int(k))
                ps.append(p if p is not None else K.gamma_tail(plain / 2, max(lags - int(k), 1) / 2))
            yield b.assign(p=ps)

    return df.mapInPandas(run, fields)


def criteria(chosen: DataFrame, lags: int = 10) -> DataFrame:
    """(book, factor, c1 ... c6 and pass_c1 ... pass_c6) of fits, one for each factor: no autocorrelation of z (weighted portmanteau, less the mean's parameters);
    none of z^2 (less the two of the variance) and no ARCH effect; the residuals' law; the model's variance over the sample's; no sign bias; constant parameters."""
    d = once(chosen)
    key = F.to_json(F.struct(S.BOOK, "factor"))  # the diagnostics work book by book: each fit is one
    z = once(d.select(key.alias(S.BOOK), F.posexplode("z").alias("i", "z")))
    c = F.col
    q = diagnostics.weighted_portmanteau(z, {"z": c("z"), "z2": c("z") * c("z")}, lags)
    q = q.join(d.select(key.alias(S.BOOK), (c("p") + c("q")).alias("_mean")), S.BOOK)
    q = q.select(S.BOOK, "series", "weighted", "plain", F.when(c("series") == "z", c("_mean")).otherwise(2).alias("fitted"))
    q = _weighted_p(q, "weighted", lags, "fitted").groupBy(S.BOOK).agg(F.max(F.when(c("series") == "z", c("p"))).alias("p_z"), F.max(F.when(c("series") == "z2", c("p"))).alias("p_z2"))
    lm = diagnostics.arch_lm(z, "z", lags).select(S.BOOK, c("p").alias("p_arch"))
    bias = diagnostics.with_p(diagnostics.sign_bias_test(z, "z")).select(S.BOOK, F.least("p_sign", "p_neg", "p_pos", "p_joint").alias("p_bias"))
    tests = q.join(lm, S.BOOK).join(bias, S.BOOK).withColumnRenamed(S.BOOK, "_key")
    critical = F.element_at(F.array(*map(F.lit, NYBLOM_5)), F.least(c("parameters"), F.lit(len(NYBLOM_5))))
    values = {"c1": c("p_z"), "c2": F.least("p_z2", "p_arch"), "c3": c("gof_mean"), "c4": c("long_run") / c("variance"), "c5": c("p_bias"), "c6": c("nyblom")}
    passed = {"c1": c("c1") > 0.05, "c2": c("c2") > 0.05, "c3": c("gof_share") >= 0.5, "c4": F.coalesce((c("c4") > 0.75) & (c("c4") < 1.25), F.lit(False)), "c5": c("c5") > 0.05, "c6": c("c6") < critical}
    out = d.withColumn("_key", key).join(tests, "_key").withColumns(values).withColumns({f"pass_{k}": v for k, v in passed.items()})
    return out.select(S.BOOK, "factor", "model", "law", "p", "q", "variance", "long_run", "persistence", *values, *(f"pass_{k}" for k in values))


#: How the tables of text call them.
TITLES = {"garch": "GARCH(1,1)", "gjr": "GJR(1,1)", "egarch": "EGARCH(1,1)", "aparch": "APARCH(1,1)"}
LAW_TITLES = {"norm": "normal", "std": "t", "sstd": "skewed t", "ged": "GED", "sged": "skewed GED", "nig": "NIG", "jsu": "JSU"}


def _title(c: str, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(c))


def summary_table(judged: DataFrame) -> DataFrame:
    """criteria() as a table of text: each factor's mean, model and innovations, and what passed."""
    mark = lambda k: F.when(F.col(f"pass_{k}"), "pass").otherwise("fail").alias(k)
    return judged.select(
        S.BOOK, "factor", F.format_string("ARMA(%d,%d)", "p", "q").alias("mean"), _title("model", TITLES).alias("model"), _title("law", LAW_TITLES).alias("innovations"), *(mark(f"c{k}") for k in range(1, 7))
    )


def variance_table(judged: DataFrame) -> DataFrame:
    """criteria()'s fourth as a table: the sample's variance, the model's, their ratio and its deviation from 1."""
    c = F.col
    return judged.select(
        S.BOOK, "factor", F.format_string("%.3e", c("variance")).alias("empirical"), F.format_string("%.3e", c("long_run")).alias("modelled"), F.round("c4", 3).alias("ratio"),
        F.format_string("%+.1f%%", 100 * (c("c4") - 1)).alias("deviation"), F.round("persistence", 3).alias("persistence"), c("pass_c4").alias("passed"),
    )


def residual_families(chosen: DataFrame, draws: int = 5000, seed: int = 42) -> DataFrame:
    """(book, factor, family, mu, sigma, skew, shape, loglik, aic, bic, ks, ks_p, rank, chosen): seven families fitted to each fit's residuals by likelihood, with
    the two-sample test against `draws` draws. chosen: of those that pass it the one of least AIC; if none does, the one of least AIC."""
    fields = "book string, factor string, family string, mu double, sigma double, skew double, shape double, loglik double, aic double, bic double, ks double, ks_p double"
    d = chosen.select(S.BOOK, "factor", "z", F.explode(F.array(*map(F.lit, families.KINDS))).alias("family"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                z = np.asarray(row.z, float)
                f = families.fit(z, row.family)
                p = dict(zip(families.KINDS[row.family].names, f["shape"]))
                out.append((row.book, row.factor, row.family, f["mu"], f["sigma"], p.get("skew"), p.get("shape"), f["loglik"], f["aic"], f["bic"], *families.ks_drawn(z, f, draws, seed)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in fields.split(", ")])

    d = dealt(d, S.BOOK, "factor", "family").mapInPandas(run, fields)
    by = Window.partitionBy(S.BOOK, "factor")
    first = by.orderBy(F.desc(F.col("ks_p") > 0.05), "aic", "family")
    return d.withColumns({"rank": F.row_number().over(by.orderBy("aic", "family")), "chosen": F.row_number().over(first) == 1})
