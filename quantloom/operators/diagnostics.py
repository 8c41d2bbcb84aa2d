"""Diagnostics of tails, dependence and residuals, as windows and aggregates."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from ..functions.pricing import norm_cdf
from .panel import frame


def rolling_quantile(df: DataFrame, value: str, q: float, window: int = S.WINDOW) -> Column:
    """The linear quantile of the `window` rows before."""
    return F.percentile(value, q).over(frame(-window, -1))


def empirical_var_es(losses: DataFrame, alpha: float = S.ALPHA, window: int = S.WINDOW) -> DataFrame:
    """(book, d, i, q, es): the window's linear quantile not under 0; the mean of losses at or over the quantile, not under it nor 0."""
    d = losses.withColumns({"_a": F.collect_list("loss").over(frame(-window, -1)), "_q": rolling_quantile(losses, "loss", alpha, window)})
    d = d.where(F.size("_a") == window)
    top = F.filter("_a", lambda x: x >= F.col("_q"))
    es = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return d.select(S.BOOK, "d", "i", F.greatest("_q", F.lit(0.0)).alias("q"), F.greatest(es, F.col("_q"), F.lit(0.0)).alias("es"))


def tail_counts(losses: DataFrame, q: float = 0.9, window: int = S.WINDOW) -> DataFrame:
    """(book, d, i, u, n_u, f_u): the window's threshold, the losses over it, and the share that are not."""
    d = losses.withColumns({"_a": F.collect_list("loss").over(frame(-window, -1)), "u": rolling_quantile(losses, "loss", q, window)}).where(F.size("_a") == window)
    d = d.withColumn("n_u", F.size(F.filter("_a", lambda x: x > F.col("u"))))
    return d.select(S.BOOK, "d", "i", "u", "n_u", (1 - F.col("n_u") / window).alias("f_u"))


def pot(u: Column, n_u: Column, xi: float, sigma: Column, window: int, alpha: float) -> tuple[Column, Column]:
    """VaR and ES beyond a threshold, of a generalised Pareto tail of given shape (not 0, under 1) and scale."""
    ratio = (window / n_u) * (1 - alpha)
    var = u + sigma / xi * (F.pow(ratio, F.lit(-xi)) - 1)
    return var, (var + sigma - xi * u) / (1 - xi)


def mean_excess(losses: DataFrame, grid) -> DataFrame:
    """(book, q, u, n, mean excess) at the quantiles of a grid."""
    u = losses.groupBy(S.BOOK).agg(F.percentile("loss", [float(x) for x in grid]).alias("us"))
    u = u.select(S.BOOK, F.posexplode("us").alias("pos", "u"))
    d = losses.join(u, S.BOOK).where("loss > u")
    return d.groupBy(S.BOOK, "pos", "u").agg(F.count("*").alias("n"), F.avg(F.col("loss") - F.col("u")).alias("excess"))


def hill(losses: DataFrame, most: int = 300) -> DataFrame:
    """(book, k, xi): mean log excess of the k greatest positive losses over the next."""
    w = Window.partitionBy(S.BOOK).orderBy(F.desc("loss"), "i")
    d = losses.where("loss > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most + 1)
    d = d.withColumn("before", F.avg(F.log("loss")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return d.where("rank > 1").select(S.BOOK, (F.col("rank") - 1).alias("k"), (F.col("before") - F.log("loss")).alias("xi"))


def pseudo_observations(df: DataFrame, columns) -> DataFrame:
    """Ranks over n + 1, ties at their mean rank: u_<column>."""
    n = F.count("*").over(Window.partitionBy(S.BOOK))
    out = {}
    for c in columns:
        ties = F.count("*").over(Window.partitionBy(S.BOOK, c))
        out[f"u_{c}"] = (F.rank().over(Window.partitionBy(S.BOOK).orderBy(c)) + (ties - 1) / 2) / (n + 1)
    return df.select(S.BOOK, "d", "i", *(v.alias(k) for k, v in out.items()))


def pairs_of(columns, measure) -> Column:
    """An array of (a, b, value) for each pair of columns."""
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), measure(F.col(a), F.col(b)).alias("value")) for a, b in itertools.combinations(columns, 2)])


def correlations(df: DataFrame, columns) -> DataFrame:
    return df.groupBy(S.BOOK).agg(pairs_of(columns, F.corr).alias("p")).select(S.BOOK, F.inline("p"))


def joint_tails(u: DataFrame, columns, a: float = 0.05) -> DataFrame:
    """How often two columns are both at a or under."""
    return u.groupBy(S.BOOK).agg(pairs_of(columns, lambda x, y: F.avg(((x <= a) & (y <= a)).cast("double"))).alias("p")).select(S.BOOK, F.inline("p"))


def ljung_box(df: DataFrame, value: str, lags: int = 10) -> DataFrame:
    """(book, n, lags, q): the portmanteau statistic from sums of lagged products."""
    w = Window.partitionBy(S.BOOK).orderBy("i")
    d = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(S.BOOK)))
    d = d.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    g = d.groupBy(S.BOOK).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"), *(F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)))
    rho = sum(F.pow(F.col(f"_s{k}") / F.col("_v"), 2) / (F.col("n") - k) for k in range(1, lags + 1))
    return g.select(S.BOOK, "n", F.lit(lags).alias("lags"), (F.col("n") * (F.col("n") + 2) * rho).alias("q"))


def chi2_tail_even(x: Column, df: int) -> Column:
    """1 - distribution function of chi-squared, for an even number of degrees of freedom: a sum of df / 2 terms."""
    return F.exp(-x / 2) * reduce(lambda acc, k: F.lit(1.0) + x / 2 / k * acc, range(df // 2 - 1, 0, -1), F.lit(1.0))


def portmanteau(df: DataFrame, series: dict[str, Column], lags=(10, 20)) -> DataFrame:
    """(book, series, n, q<lags>, p<lags>): Ljung-Box tests of several series of the same rows, in one pass."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("series"), v.cast("double").alias("_v")) for k, v in series.items()]))
    by = (S.BOOK, "series")
    w = Window.partitionBy(*by).orderBy("i")
    d = df.select(S.BOOK, "i", rows).withColumn("_c", F.col("_v") - F.avg("_v").over(Window.partitionBy(*by)))
    most = max(lags)
    d = d.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, most + 1)})
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *(F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, most + 1)))
    q = {f"q{m}": F.col("n") * (F.col("n") + 2) * sum(F.pow(F.col(f"_s{k}") / F.col("_s0"), 2) / (F.col("n") - k) for k in range(1, m + 1)) for m in lags}
    g = g.withColumns(q).withColumns({f"p{m}": chi2_tail_even(F.col(f"q{m}"), m) for m in lags})
    return g.select(*by, "n", *(c for m in lags for c in (f"q{m}", f"p{m}")))


def weighted_portmanteau(df: DataFrame, series: dict[str, Column], lags: int = 10) -> DataFrame:
    """(book, series, n, plain, weighted): Ljung-Box statistics of several series of the same rows, and those with weights that fall from 1 to 1 / lags."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("series"), v.cast("double").alias("_v")) for k, v in series.items()]))
    by = (S.BOOK, "series")
    w = Window.partitionBy(*by).orderBy("i")
    d = df.select(S.BOOK, "i", rows).withColumn("_c", F.col("_v") - F.avg("_v").over(Window.partitionBy(*by)))
    d = d.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *(F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)))
    own = [F.pow(F.col(f"_s{k}") / F.col("_s0"), 2) / (F.col("n") - k) for k in range(1, lags + 1)]
    scale = F.col("n") * (F.col("n") + 2)
    return g.select(*by, "n", (scale * sum(own)).alias("plain"), (scale * sum((lags - k) / lags * x for k, x in enumerate(own))).alias("weighted"))


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """(book, n, ks): the greatest distance from a normal of the sample's mean and standard deviation."""
    every = Window.partitionBy(S.BOOK)
    d = df.withColumn("_z", (F.col(value) - F.avg(value).over(every)) / F.stddev_samp(value).over(every))
    d = d.withColumns({"_k": F.row_number().over(every.orderBy("_z")), "_n": F.count("*").over(every), "_p": norm_cdf(F.col("_z"))})
    gap = F.greatest(F.col("_k") / F.col("_n") - F.col("_p"), F.col("_p") - (F.col("_k") - 1) / F.col("_n"))
    return d.groupBy(S.BOOK).agg(F.count("*").alias("n"), F.max(gap).alias("ks"))


def ks_two(df: DataFrame, value: str, side: Column) -> DataFrame:
    """(book, n_a, n_b, ks): the greatest distance of the distribution functions of rows where `side` holds and the others."""
    every = Window.partitionBy(S.BOOK)
    up_to = every.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_a", side.cast("long")).withColumns({"_na": F.sum("_a").over(every), "_n": F.count("*").over(every), "_ca": F.sum("_a").over(up_to), "_c": F.count("*").over(up_to)})
    gap = F.abs(F.col("_ca") / F.col("_na") - (F.col("_c") - F.col("_ca")) / (F.col("_n") - F.col("_na")))
    return d.groupBy(S.BOOK).agg(F.max("_na").alias("n_a"), (F.max("_n") - F.max("_na")).alias("n_b"), F.max(gap).alias("ks"))


def normal_equations(df: DataFrame, y: Column, xs: dict[str, Column]) -> DataFrame:
    """(book, n, yy, xy_<a>, xx_<a>_<b>): the sums that a least-squares fit needs; the fit itself is a small solve."""
    cols = {"one": F.lit(1.0)} | xs
    aggs = [F.count("*").alias("n"), F.sum(y * y).alias("yy")] + [F.sum(y * x).alias(f"xy_{k}") for k, x in cols.items()]
    aggs += [F.sum(cols[a] * cols[b]).alias(f"xx_{a}_{b}") for a, b in itertools.combinations_with_replacement(cols, 2)]
    return df.groupBy(S.BOOK).agg(*aggs)


def sign_bias(df: DataFrame, z: str) -> DataFrame:
    """Sums of the regression of z^2 on the sign, negative and positive size of the z before."""
    d = df.withColumn("_b", F.lag(z).over(Window.partitionBy(S.BOOK).orderBy("i"))).where("_b is not null")
    neg = (F.col("_b") < 0).cast("double")
    return normal_equations(d, F.col(z) * F.col(z), {"neg": neg, "negsize": neg * F.col("_b"), "possize": (1 - neg) * F.col("_b")})


def sign_bias_test(df: DataFrame, z: str) -> DataFrame:
    """(book, n, c0, sign, neg_size, pos_size, t_sign, t_neg, t_pos, f): z^2 regressed on a constant, the sign and the sizes of the z before.

    With a sign and a size for either side it is two lines, one for each side: their slopes and the difference of their constants, with one
    variance of what is left; f is that of all three being 0.
    """
    d = df.withColumn("_b", F.lag(z).over(Window.partitionBy(S.BOOK).orderBy("i"))).where("_b is not null").withColumn("_y", F.col(z) * F.col(z))
    side = {"n": F.col("_b") < 0, "p": F.col("_b") >= 0}
    aggs = [F.count("*").alias("n"), F.regr_syy("_y", "_b").alias("_all")]
    for k, on in side.items():
        y, x = F.when(on, F.col("_y")), F.when(on, F.col("_b"))
        aggs += [f(y, x).alias(f"_{name}_{k}") for name, f in (("count", F.regr_count), ("slope", F.regr_slope), ("const", F.regr_intercept), ("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy), ("x", F.regr_avgx))]
    c = F.col
    g = d.groupBy(S.BOOK).agg(*aggs)
    left = sum(c(f"_syy_{k}") - c(f"_sxy_{k}") * c(f"_sxy_{k}") / c(f"_sxx_{k}") for k in side)
    g = g.withColumn("_left", left).withColumn("_s2", c("_left") / (c("n") - 4))
    spread = sum(1 / c(f"_count_{k}") + c(f"_x_{k}") * c(f"_x_{k}") / c(f"_sxx_{k}") for k in side)
    sign = c("_const_n") - c("_const_p")
    return g.select(
        S.BOOK, "n", c("_const_p").alias("c0"), sign.alias("sign"), c("_slope_n").alias("neg_size"), c("_slope_p").alias("pos_size"),
        (sign / F.sqrt(c("_s2") * spread)).alias("t_sign"), (c("_slope_n") / F.sqrt(c("_s2") / c("_sxx_n"))).alias("t_neg"), (c("_slope_p") / F.sqrt(c("_s2") / c("_sxx_p"))).alias("t_pos"),
        ((c("_all") - c("_left")) / 3 / c("_s2")).alias("f"),
    )


def with_p(tests: DataFrame) -> DataFrame:
    """sign_bias_test()'s rows with p_sign, p_neg, p_pos and p_joint."""
    fields = ", ".join(f"{c} {k}" for c, k in tests.dtypes) + ", p_sign double, p_neg double, p_pos double, p_joint double"

    def run(batches):
        for b in batches:
            for name, t in (("p_sign", "t_sign"), ("p_neg", "t_neg"), ("p_pos", "t_pos")):
                b[name] = [K.t_two_sided(x, n - 4) for x, n in zip(b[t], b["n"])]
            b["p_joint"] = [K.f_tail(x, 3, n - 4) for x, n in zip(b["f"], b["n"])]
            yield b

    return tests.mapInPandas(run, fields)


def least_squares(df: DataFrame, y: Column, xs: dict[str, Column]) -> DataFrame:
    """(book, n, rss, r2, b_<x>, t_<x>) of a regression with a constant (one): sums in one pass, and a small solve for each book. Rows with a null
    regressor have no part."""
    names = ["one", *xs]
    sums = normal_equations(df.where(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs.values()])), y, xs)
    fields = "book string, n long, rss double, r2 double, " + ", ".join([f"b_{k} double" for k in names] + [f"t_{k} double" for k in names])

    def run(batches):
        for b in batches:
            out = []
            for _, row in b.iterrows():
                m = np.array([[row[f"xx_{names[min(i, j)]}_{names[max(i, j)]}"] for j in range(len(names))] for i in range(len(names))])
                v, n = np.array([row[f"xy_{k}"] for k in names]), row["n"]
                # columns of one scale, so that the solve is as exact as the sums are
                scale = np.sqrt(np.diag(m))
                inverse = np.linalg.inv(m / np.outer(scale, scale)) / np.outer(scale, scale)
                beta = inverse @ v
                rss = float(row["yy"] - beta @ v)
                out.append((row["book"], n, rss, 1 - rss / (row["yy"] - v[0] ** 2 / n), *beta, *(beta / np.sqrt(np.diag(inverse) * rss / (n - len(names))))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in fields.split(", ")])

    return sums.mapInPandas(run, fields)


def arch_lm(df: DataFrame, z: str, lags: int = 10) -> DataFrame:
    """(book, n, lm, p): n R^2 of z^2 on its last `lags`."""
    w = Window.partitionBy(S.BOOK).orderBy("i")
    d = df.withColumn("_y", F.col(z) * F.col(z))
    d = d.withColumns({f"_l{k}": F.lag("_y", k).over(w) for k in range(1, lags + 1)})
    out = least_squares(d, F.col("_y"), {f"l{k}": F.col(f"_l{k}") for k in range(1, lags + 1)})
    out = out.select(S.BOOK, "n", (F.col("n") * F.col("r2")).alias("lm"))
    return out.withColumn("p", chi2_tail_even(F.col("lm"), lags))


#: Quantiles of the Dickey-Fuller t statistic with constant and trend, by sample size (rows) and probability.
DF_PROBABILITIES = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
DF_SIZES = (25, 50, 100, 250, 500, 100_000)
DF_QUANTILES = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)


def _between(x: Column, xs, ys) -> Column:
    """The line through points (xs: numbers that grow, ys: Columns or numbers), held to its ends."""
    ys = [y if isinstance(y, Column) else F.lit(float(y)) for y in ys]
    xs = [v if isinstance(v, Column) else F.lit(float(v)) for v in xs]
    out = ys[-1]
    for k in reversed(range(len(xs) - 1)):
        out = F.when(x < xs[k + 1], ys[k] + (x - xs[k]) / (xs[k + 1] - xs[k]) * (ys[k + 1] - ys[k])).otherwise(out)
    return F.when(x <= xs[0], ys[0]).otherwise(out)


def dickey_fuller_p(t: Column, n: Column) -> Column:
    """p of a statistic of n differences: the table between its sizes, then between its quantiles."""
    return _between(t, [_between(n, DF_SIZES, [row[j] for row in DF_QUANTILES]) for j in range(len(DF_PROBABILITIES))], DF_PROBABILITIES)


def dickey_fuller(df: DataFrame, value: str, lags: int | None = None) -> DataFrame:
    """(book, n, lags, t, p): the augmented test of a unit root, with constant and trend. lags: of the differences; by default the whole part of the cube root of
    one less than the book's rows, so books of several sizes have several; there is one regression for each number of lags, of which there are few."""
    rows = df.groupBy(S.BOOK).agg(F.count(value).alias("_rows"))
    rows = rows.withColumn("_lags", F.lit(lags) if lags is not None else F.floor(F.pow(F.greatest(F.col("_rows") - 1, F.lit(0)), F.lit(1 / 3)) + 1e-9).cast("int"))
    several = [r._lags for r in rows.select("_lags").distinct().orderBy("_lags").collect()]
    out = [_dickey_fuller(df.join(rows.where(F.col("_lags") == k), S.BOOK), value, k).join(rows, S.BOOK) for k in several]
    out = reduce(DataFrame.unionByName, out) if out else _dickey_fuller(df, value, 0).join(rows, S.BOOK)
    t = F.col("t_before")
    return out.select(S.BOOK, "n", F.col("_lags").alias("lags"), t.alias("t"), dickey_fuller_p(t, F.col("_rows") - 1).alias("p"))


def _dickey_fuller(df: DataFrame, value: str, lags: int) -> DataFrame:
    w = Window.partitionBy(S.BOOK).orderBy("i")
    d = df.withColumn("_x", F.col(value)).withColumn("_d", F.col("_x") - F.lag("_x").over(w))
    d = d.withColumns({"_b": F.lag("_x").over(w), "_n": F.row_number().over(w)} | {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    out = least_squares(d, F.col("_d"), {"before": F.col("_b"), "trend": F.col("_n").cast("double")} | {f"l{k}": F.col(f"_l{k}") for k in range(1, lags + 1)})
    return out.select(S.BOOK, "n", "t_before")


def quantiles_type8(df: DataFrame, value: str, us) -> DataFrame:
    """(book, u, q): quantiles at (n + 1/3) u + 1/3, between order statistics."""
    every = Window.partitionBy(S.BOOK)
    d = df.select(S.BOOK, F.col(value).alias("_v"), F.row_number().over(every.orderBy(value)).alias("_k"), F.count("*").over(every).alias("_n"))
    at = lambda u: F.least(F.greatest((F.col("_n") + 1 / 3) * u + 1 / 3, F.lit(1.0)), F.col("_n").cast("double"))
    aggs = []
    for j, u in enumerate(us):
        k = F.floor(at(u))
        aggs += [F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_a{j}"), F.max(F.when(F.col("_k") == k + 1, F.col("_v"))).alias(f"_b{j}"), F.max(at(u) - k).alias(f"_g{j}")]
    q = [F.struct(F.lit(u).alias("u"), (F.col(f"_a{j}") + F.when(F.col(f"_g{j}") > 0, F.col(f"_g{j}") * (F.col(f"_b{j}") - F.col(f"_a{j}"))).otherwise(0.0)).alias("q")) for j, u in enumerate(us)]
    return d.groupBy(S.BOOK).agg(*aggs).select(S.BOOK, F.inline(F.array(*q)))
