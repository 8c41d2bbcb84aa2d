"""The registered queries: each (spark, sf_dir) -> DataFrame, doubles rounded so that engines can be compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import pricing
from ..operators import analysis, backtest, book, delta_normal, dependence, diagnostics, garch, hist_sim, monte_carlo, panel, scenarios, selection, tails, validation
from ..operators.once import fresh_path, once
from ..sources import market

#: Fixed parameters of the queries that show formulas apart from fits.
XI, SIGMA = 0.15, 2e4
Z_95 = 1.6448536269514722
US = (0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999)
OMEGA, G_ALPHA, G_BETA, G_MU = 0.05, 0.1, 0.85, 0.0


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.levels(market.lineitem_panel(spark, sf_dir))


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles at n digits; -0 as 0."""
    return df.select(*((F.round(c, n) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _of(f: Callable[[DataFrame], DataFrame], n: int = 6) -> Callable:
    return lambda spark, sf_dir: rounded(f(levels(spark, sf_dir)), n)


def total_pnl(lv: DataFrame) -> DataFrame:
    """(book, d, i, pnl): the P&L of the whole book, which every estimate is held against."""
    return book.pnl(lv).select(S.BOOK, "d", "i", F.col("pnl_total").alias("pnl"))


def portfolio_losses(lv: DataFrame) -> DataFrame:
    """(book, d, i, pnl, loss): the book's P&L and its negative, in money."""
    return total_pnl(lv).withColumn("loss", -F.col("pnl"))


def series(lv: DataFrame) -> DataFrame:
    """(book, d, i, r) with i from 0, for the GARCH operators: the book's P&L over its value at inception."""
    return total_pnl(lv).select(S.BOOK, "d", (F.col("i") - 1).alias("i"), (F.col("pnl") / S.V0).alias("r"))


def against(est: DataFrame, pnl: DataFrame) -> DataFrame:
    """Estimates (book, d, var, maybe es) as backtests take them: with the P&L (book, d, pnl) of their days. Without an es, var stands there."""
    es = F.col("es") if "es" in est.columns else F.col("var")
    return est.select(S.BOOK, "d", "var", es.alias("es")).join(pnl.select(S.BOOK, "d", "pnl"), [S.BOOK, "d"]).select(S.BOOK, "d", "pnl", "var", "es")


def dn_rows(lv: DataFrame, window: int = S.WINDOW) -> DataFrame:
    return delta_normal.rolling(lv, window).select(S.BOOK, "d", F.col("var_full").alias("var"), F.col("es_full").alias("es"))


def dn_backtest(lv: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """Delta-normal estimates, which are of the linear part, against the whole book's P&L."""
    lv = once(lv)
    return against(dn_rows(lv, window), total_pnl(lv))


def dn_linear(lv: DataFrame) -> DataFrame:
    """The same estimates against the P&L of the linear part alone."""
    lv = once(lv)
    return against(dn_rows(lv), book.pnl(lv).select(S.BOOK, "d", F.col("pnl_linear").alias("pnl")))


def with_exceptions(lv: DataFrame) -> DataFrame:
    return dn_backtest(lv).withColumn("exception", (F.col("pnl") < -F.col("var")).cast("int"))


def hs_backtest(lv: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """Historical simulation against its own revaluation of the next day."""
    return hist_sim.rolling(lv, window).select(S.BOOK, "d", F.col("realised_pnl").alias("pnl"), "var", "es")


def united(parts: dict, name: str) -> DataFrame:
    """Tables of (book, d, pnl, var, es), each with its key as column `name`."""
    rows = [d.select(F.lit(k).alias(name), S.BOOK, "d", "pnl", "var", "es") for k, d in parts.items()]
    return reduce(DataFrame.unionByName, rows)


TESTS = ("t", "n", "n00", "n01", "n10", "n11", "lr_uc", "lr_ind", "lr_cc", "p_uc", "p_ind", "p_cc", "expected_n", "rate", "reject_uc", "reject_ind", "reject_cc", "lower", "upper", "binomial_p", "binomial_reject")


def asof_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = levels(spark, sf_dir).select(S.BOOK, "d", "i")
    return rounded(panel.as_of(lv, market.orders_index(spark, sf_dir), ["order_idx"]), 4)


def delta_normal_windows(lv: DataFrame) -> DataFrame:
    lv = once(lv)
    d = united({w: dn_backtest(lv, w) for w in (250, 500, 750)}, "window")
    return analysis.summarize(d, ("window",)).select("window", "t", "n", "p_uc", "p_cc", "mean_var", "mean_es", "max_var")


SENSITIVITY = ("t", "n", "rate", "p_uc", "p_cc", "mean_var", "mean_es", "max_var")


def delta_normal_ewma_tests(lv: DataFrame) -> DataFrame:
    """Weighted covariances beside the plain one (lam 1), against the book's P&L."""
    lv = once(lv)
    pnl = once(total_pnl(lv))
    rows = {lam: delta_normal.ewma(lv, lam).select(S.BOOK, "d", F.col("var_full").alias("var"), F.col("es_full").alias("es")) for lam in (0.94, 0.97)}
    d = united({k: against(v, pnl) for k, v in ({1.0: dn_rows(lv)} | rows).items()}, "lam")
    return analysis.summarize(d, ("lam",)).select("lam", *SENSITIVITY)


def delta_normal_diag_tests(lv: DataFrame) -> DataFrame:
    """Correlations of the window beside none, against the book's P&L."""
    lv = once(lv)
    pnl, d = once(total_pnl(lv)), once(delta_normal.diagonal(lv))
    parts = {k: against(d.select(S.BOOK, "d", F.col(f"var_{k}").alias("var"), F.col(f"es_{k}").alias("es")), pnl) for k in ("full", "diagonal")}
    return analysis.summarize(united(parts, "covariance"), ("covariance",)).select("covariance", *SENSITIVITY)


def delta_t_normal_tests(lv: DataFrame) -> DataFrame:
    """Student-t quantiles beside normal ones, against the book's P&L."""
    lv = once(lv)
    parts = {"normal": dn_backtest(lv), "t": delta_t_normal(lv)}
    return analysis.summarize(united(parts, "law"), ("law",)).select("law", *SENSITIVITY)


def delta_normal_crisis(lv: DataFrame) -> DataFrame:
    d = analysis.in_windows(dn_backtest(lv))
    return analysis.summarize(d).select("label", "t", "n", "expected_n", "p_uc", "p_ind", "p_cc", "severity", "mean_var", "mean_es")


def delta_t_normal(lv: DataFrame) -> DataFrame:
    """Student-t quantiles with one nu for each book, fitted on its whole series in a task of its own."""
    lv = once(lv)
    x = panel.portfolio_return(lv)

    def fit(pdf):
        import pandas as pd

        from ..functions import kernels as K

        nu = max(K.t_fit(pdf["x"].to_numpy())[0], 2.1)
        z = float(K.t_ppf(S.ALPHA, nu))
        es = float(K.np.exp(K.t_logpdf(z, nu))) / (1 - S.ALPHA) * (nu + z * z) / (nu - 1)
        return pd.DataFrame({"book": [pdf["book"].iloc[0]], "nu": [nu], "z": [z], "es_factor": [es]})

    nus = x.select(S.BOOK, "x").groupBy(S.BOOK).applyInPandas(fit, "book string, nu double, z double, es_factor double")
    d = delta_normal.rolling(lv).join(nus, S.BOOK).join(total_pnl(lv).select(S.BOOK, "d", "pnl"), [S.BOOK, "d"])
    return d.select(S.BOOK, "d", "i", "nu", (F.col("z") * F.col("sigma") - F.col("mu")).alias("var"), (F.col("es_factor") * F.col("sigma") - F.col("mu")).alias("es"), "pnl")


def hist_windows(lv: DataFrame) -> DataFrame:
    d = hist_sim.over_windows(lv, (250, 500, 750))
    return analysis.summarize(d, ("window",)).select("window", "t", "n", "p_uc", "p_ind", "p_cc", "severity", "mean_var", "mean_es", "max_var")


def hist_subperiods(lv: DataFrame) -> DataFrame:
    d = analysis.in_windows(hs_backtest(lv), others=None)
    return analysis.summarize(d).select("label", "first_d", "last_d", "t", "n", "expected_n", "p_uc", "p_ind", "p_cc", "severity", "mean_var", "mean_es")


def component_summary(lv: DataFrame) -> DataFrame:
    d = hist_sim.components(lv).withColumnRenamed("realised_pnl", "pnl")
    return analysis.summarize(d, ("component",)).select("component", "t", "n", "expected_n", "p_uc", "p_ind", "p_cc", "severity", "mean_var", "mean_es")


def extreme_days(lv: DataFrame) -> DataFrame:
    lv = once(lv)
    d = analysis.extreme_days(hist_sim.rolling(lv), hist_sim.realised_parts(lv))
    return d.select("d", "realised_loss", "var", *S.COMPONENTS, "driver")


def pot_fixed(lv: DataFrame) -> DataFrame:
    d = diagnostics.tail_counts(portfolio_losses(lv))
    var, es = diagnostics.pot(F.col("u"), F.col("n_u"), XI, F.lit(SIGMA), S.WINDOW, S.ALPHA)
    return d.select(S.BOOK, "d", "u", "n_u", "f_u", var.alias("var"), es.alias("es"))


def garch_fixed(lv: DataFrame) -> DataFrame:
    """The recursion in segments of 50 days, each from the stationary variance; returns in units of the sample's deviation."""
    s = series(lv)
    every = Window.partitionBy(S.BOOK)
    d = s.withColumn("r", F.col("r") / F.stddev_samp("r").over(every)).withColumn("refit", F.floor(F.col("i") / 50).cast("int"))
    seg = Window.partitionBy(S.BOOK, "refit").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_e", F.collect_list(F.pow(F.col("r") - G_MU, 2)).over(seg))
    s2 = garch.fold(F.lit(OMEGA), F.lit(G_ALPHA), F.lit(G_BETA), F.lit(OMEGA / (1 - G_ALPHA - G_BETA)), F.col("_e"))
    d = d.withColumn("sigma", F.sqrt(s2)).withColumn("z", (F.col("r") - G_MU) / F.col("sigma"))
    return d.select(S.BOOK, "d", "i", "refit", "r", "sigma", "z")


#: Fixed parameters of the three recursions: omega, alpha, beta, gamma, delta.
RECURSIONS = {"garch": (0.05, 0.1, 0.85, 0.0, 2.0), "gjr": (0.05, 0.05, 0.85, 0.08, 2.0), "aparch": (0.05, 0.08, 0.85, 0.3, 1.5)}


def _volatility(model: str, *p: float):
    return F.aggregate("_e", F.lit(1.0), lambda s, e: garch.advance(model, s, e, *p))


def volatility_recursions(lv: DataFrame) -> DataFrame:
    """Three variance recursions in segments of 50 days, each from volatility 1; returns in units of the sample's deviation."""
    d = series(lv).withColumn("r", F.col("r") / F.stddev_samp("r").over(Window.partitionBy(S.BOOK))).withColumn("refit", F.floor(F.col("i") / 50).cast("int"))
    seg = Window.partitionBy(S.BOOK, "refit").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_e", F.collect_list("r").over(seg))
    folds = [_volatility(m, *p).alias(f"sigma_{m}") for m, p in RECURSIONS.items()]
    return d.select(S.BOOK, "d", "i", "refit", *folds)


def fhs_fixed(lv: DataFrame) -> DataFrame:
    d = garch.filtered(garch_fixed(lv).withColumn("mu", F.lit(G_MU)))
    return d.select(S.BOOK, "d", "i", "sigma", "var")


def ewma_correlation(lv: DataFrame, lam: float = 0.94, window: int = 250) -> DataFrame:
    """EWMA correlation of two returns over the window before: sums weighted by age."""
    d = panel.log_returns(lv)
    w = panel.frame(-window, -1)
    d = d.withColumn("_a", F.collect_list(F.struct("r_b", "r_d")).over(w)).where(F.size("_a") == window)
    total = lambda f: F.aggregate("_a", F.lit(0.0), lambda acc, x: acc * lam + f(x))
    c = total(lambda x: x["r_b"] * x["r_d"]) / F.sqrt(total(lambda x: x["r_b"] * x["r_b"]) * total(lambda x: x["r_d"] * x["r_d"]))
    return d.select(S.BOOK, "d", "i", c.alias("corr"))


def moments(lv: DataFrame) -> DataFrame:
    d = book.pnl(lv)
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"pnl_{c}").alias("v")) for c in (*S.COMPONENTS, "total")]))
    return d.select(rows).groupBy("component").agg(*(c.alias(k) for k, c in analysis.moments(F.col("v")).items()))


RETURNS = [f"r_{c[-1]}" for c in S.ASSETS]


def pseudo_obs(lv: DataFrame) -> DataFrame:
    return diagnostics.pseudo_observations(panel.log_returns(lv), RETURNS)


def param_stability(lv: DataFrame) -> DataFrame:
    return analysis.stability(diagnostics.tail_counts(portfolio_losses(lv)), ("u", "n_u", "f_u"))


def evt_stability(lv: DataFrame) -> DataFrame:
    """How far the rolling tail's parameters move over the windows that were fitted, and how many were not, were clamped, or fit poorly."""
    c = F.col
    clean = c("fallback") == "none"
    counts = {"n_clean_windows": clean, "n_total_windows": F.lit(True), "n_fallbacks": ~clean, "n_xi_clamped": c("clamped"), "n_poor_ks": c("ks_p") < 0.05}
    return analysis.stability_with_counts(once(evt_var(lv)), ("var", "var_raw", "var_mle", "es", "es_raw", "xi", "xi_raw", "sigma", "u", "n_u", "f_u"), counts, clean)


def garch_stability(lv: DataFrame) -> DataFrame:
    """How far the filter's parameters move from refit to refit, as fitted (raw) and as used, and how many refits were near-integrated and given others."""
    fits = once(_fits(lv))
    raw = fits.select(S.BOOK, "refit", *(F.col(p).alias(f"raw_{p}") for p in ("mu", "omega", "alpha", "beta")))
    d = garch.guarded(fits).join(raw, [S.BOOK, "refit"])
    d = d.withColumns({"persistence": F.col("alpha") + F.col("beta"), "raw_persistence": F.col("raw_alpha") + F.col("raw_beta")})
    moved = F.col("reverted") & (F.col("persistence") != F.col("raw_persistence"))  # the first refits may have none to go back to
    counts = {"n_refits": F.lit(True), "near_integrated_count": F.col("reverted"), "stationarity_fallback_count": moved}
    names = ("mu", "omega", "alpha", "beta", "persistence")
    return analysis.stability_with_counts(once(d.drop("sigma")), (*names, *(f"raw_{n}" for n in names), "nu"), counts, order="refit")


def stability_counts(lv: DataFrame) -> DataFrame:
    """Stability of thresholds and exceedances over calm windows, those whose threshold isn't above the book's mean, with counts of these and of all."""
    d = diagnostics.tail_counts(portfolio_losses(lv)).withColumn("calm", F.col("u") <= F.avg("u").over(Window.partitionBy(S.BOOK)))
    calm = F.col("calm")
    return analysis.stability_with_counts(once(d), ("u", "n_u", "f_u"), {"n_clean_windows": calm, "n_total_windows": F.lit(True)}, calm)


def found_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates written as CSV under names of another program, and read again by the look of their columns."""
    at = fresh_path(spark, "estimates")
    d = dn_backtest(levels(spark, sf_dir))
    market.write_result(d.select(F.lit("dn").alias("note"), F.col("d").alias("day"), (-F.col("pnl")).alias("actual_loss"), F.col("var").alias("VaR_95")), at, "csv")
    return rounded(market.read_estimates(spark, at), 4)


def stress_worst(lv: DataFrame, n: int = 10) -> DataFrame:
    """The n shocks of all history that are worst for today's book."""
    lv = once(lv)
    snap = hist_sim.snapshots(lv)
    last = snap.join(snap.groupBy(S.BOOK).agg(F.max("f").alias("f")), [S.BOOK, "f"])
    s = panel.hist_shocks(lv).select(S.BOOK, F.col("d").alias("shock_d"), *panel.SHOCKS)
    d = hist_sim.price_scenarios(s.join(last.drop("d"), S.BOOK))
    w = Window.partitionBy(S.BOOK).orderBy(F.desc("loss"), "shock_d")
    d = d.withColumn("loss", hist_sim.loss()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return d.select(S.BOOK, "rank", "shock_d", "loss", "pnl_linear", "pnl_irs", "pnl_straddle")


def two_methods(lv: DataFrame) -> DataFrame:
    """Delta-normal and historical simulation against one P&L."""
    lv = once(lv)
    pnl = once(total_pnl(lv))
    return united({"delta_normal": against(dn_rows(lv), pnl), "hist_sim": against(hist_sim.rolling(lv), pnl)}, "method")


def compare_methods(lv: DataFrame) -> DataFrame:
    return backtest.run(two_methods(lv), ("method",)).select("method", *TESTS)


#: Columns of money in crisis tables, which are given in cents.
MONEY = ("mean_var", "mean_es", "max_var", "max_es", "mean_loss", "max_loss", "mean_exception_loss", "max_exception_loss")


def crisis_methods(lv: DataFrame) -> DataFrame:
    return in_cents(analysis.crisis_table(once(two_methods(lv).drop(S.BOOK))))


def in_cents(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in MONEY})


def irs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = levels(spark, sf_dir).withColumn("_r", book.rate(F.col("rate_idx")))
    return rounded(d.select(S.BOOK, "d", pricing.irs_value(F.col("_r")).alias("value"), pricing.irs_dv01(F.col("_r")).alias("dv01"), pricing.annuity(F.col("_r"), 10, 2).alias("annuity_semi")), 4)


def straddle_greeks(lv: DataFrame) -> DataFrame:
    d = book.straddle_state(lv).withColumn("_r", book.rate(F.col("rate_idx")))
    d = pricing.with_straddle(d, "price", F.col(S.UNDERLYING), F.col("strike"), F.col("tenor"), F.col("_r"), F.col("vol_idx") / 100, greeks=True)
    return d.select(S.BOOK, "d", "strike", "tenor", "price", "price_delta", "price_gamma", "price_vega", "price_theta")


HS_COLUMNS = ("d", "snapshot_d", "value", "var", "es", "mean_loss", "vol_loss", "tail_scenarios", "realised_loss", "realised_pnl", "exception")

# --- fits and simulations: no SQL; tests hold them against properties and other implementations ---------------------------------------


def evt_var(lv: DataFrame) -> DataFrame:
    return tails.rolling(portfolio_losses(lv))


def crisis_tails(lv: DataFrame) -> DataFrame:
    """crisis_methods() for the two tail estimators."""
    lv = once(lv)
    pnl = once(total_pnl(lv))
    d = united({"evt": against(evt_var(lv), pnl), "garch_evt": against(garch_evt_var(lv), pnl)}, "method")
    return in_cents(analysis.crisis_table(once(d.drop(S.BOOK))))


def dn_violations(lv: DataFrame) -> DataFrame:
    """Delta-normal rows that break what always holds: ES >= VaR >= 0, deviation > 0, no nulls."""
    c = F.col
    bad = (c("es_full") < c("var_full")) | (c("es_nodrift") < c("var_nodrift")) | (c("sigma") <= 0) | (c("var_full") < 0)
    return delta_normal.rolling(lv).where(F.coalesce(bad, F.lit(True))).select(S.BOOK, "d", "var_full", "es_full", "sigma")


def garch_evt_violations(lv: DataFrame) -> DataFrame:
    """Filtered tail rows that break what always holds: ES >= VaR >= 0, volatility > 0, shape in [-0.5, 1]."""
    c = F.col
    bad = (c("es") < c("var") - 1e-9) | (c("var") < 0) | (c("vol") <= 0) | c("var").isNull() | F.coalesce((c("xi") < -0.5) | (c("xi") > 1), F.lit(False))
    return garch_evt_var(lv).where(bad).select(S.BOOK, "d", "vol", "xi", "var", "es")


QS = (0.85, 0.9, 0.925, 0.95)


def evt_grid(lv: DataFrame) -> DataFrame:
    """Thresholds by windows from a common first day, summarised."""
    d = tails.grid(portfolio_losses(lv), QS, (250, 500, 750), first=751).withColumn("pnl", -F.col("loss"))
    extra = [F.avg("xi").alias("mean_xi"), F.sum((F.col("fallback") != "none").cast("long")).alias("fallbacks")]
    return analysis.summarize(d, ("q", "window"), extra=extra).select("q", "window", "t", "n", "p_uc", "p_cc", "mean_var", "mean_es", "max_var", "max_es", "mean_xi", "fallbacks")


def _fits(lv: DataFrame, rolling: bool = False) -> DataFrame:
    return garch.refits(series(lv), rolling=rolling)


def garch_params(lv: DataFrame) -> DataFrame:
    return garch.guarded(_fits(lv)).drop("sigma")


def _resid(lv: DataFrame, rolling: bool = False, every: int = garch.REFIT) -> DataFrame:
    r = once(series(lv))
    return garch.residuals(r, garch.refits(r, rolling=rolling, every=every), every=every)


def garch_evt_var(lv: DataFrame) -> DataFrame:
    return garch.garch_evt(_resid(lv)).select(S.BOOK, "d", "i", "r", "mu", "vol", "xi", "fallback", "q_z", "var", "es")


def fhs_var(lv: DataFrame) -> DataFrame:
    return garch.filtered(_resid(lv))


def garch_challenger(lv: DataFrame) -> DataFrame:
    """Refits on the window before instead of all history."""
    return garch.garch_evt(_resid(lv, rolling=True)).select(S.BOOK, "d", "i", "r", "vol", "var", "es")


_EVT_EXTRA = lambda: [F.avg("xi").alias("mean_xi"), F.avg("vol").alias("mean_vol"), F.avg("es_z").alias("mean_es_z"), F.sum((F.col("fallback") != "none").cast("long")).alias("fallbacks"), F.sum((F.col("es_fallback") != "none").cast("long")).alias("es_fallbacks"), F.sum((F.col("ks_p") < 0.05).cast("long")).alias("poor_ks")]
_EVT_COLUMNS = ("t", "n", "rate", "p_uc", "p_cc", "mean_var", "mean_es", "max_es", "mean_xi", "mean_vol", "mean_es_z", "fallbacks", "es_fallbacks", "poor_ks")


def garch_thresholds(lv: DataFrame) -> DataFrame:
    """The tail step at other thresholds, with the GARCH as it is."""
    d = garch.garch_evt(_resid(lv), qs=QS).withColumn("pnl", S.V0 * F.col("r"))
    return analysis.summarize(d, ("q",), extra=_EVT_EXTRA()).select("q", *_EVT_COLUMNS)


def garch_compare(lv: DataFrame) -> DataFrame:
    """Refits on all history beside refits on the window before."""
    lv = once(lv)
    parts = [garch.garch_evt(_resid(lv, rolling)).withColumn("fits", F.lit(name)) for rolling, name in ((False, "expanding"), (True, "rolling"))]
    d = parts[0].unionByName(parts[1]).withColumn("pnl", S.V0 * F.col("r"))
    return analysis.summarize(d, ("fits",), extra=_EVT_EXTRA()).select("fits", *_EVT_COLUMNS)


def refit_sweep(lv: DataFrame) -> DataFrame:
    """GARCH-copula simulation with refits every 10, 25 and 50 days; days that they share are fitted once."""
    lv = once(lv)
    rows, _ = monte_carlo.refit_sweep(lv)
    pnl = once(total_pnl(lv))
    d = united({k: against(v, pnl) for k, v in rows.items()}, "every")
    return analysis.summarize(d, ("every",)).select("every", "t", "n", "rate", "p_uc", "p_ind", "p_cc", "mean_var", "max_var")


def window_sweep(lv: DataFrame) -> DataFrame:
    """GARCH-copula simulation on windows of 250, 500 and 750 days."""
    lv = once(lv)
    pnl = once(total_pnl(lv))
    out = united({n: against(monte_carlo.garch_copula(lv, window=n), pnl) for n in (250, 500, 750)}, "window")
    return analysis.summarize(out, ("window",)).select("window", "t", "n", "rate", "p_uc", "p_ind", "p_cc", "mean_var", "max_var")


def factor_orders(lv: DataFrame) -> DataFrame:
    """The mean's order of each factor of the book's P&L by moves: the first by AIC."""
    return selection.arma_orders(panel.risk_factors(lv), monte_carlo.MOVES)


def factor_fits(lv: DataFrame) -> DataFrame:
    """Four volatility models with seven laws for each factor, with its own ARMA mean."""
    lv = once(lv)
    orders = once(factor_orders(lv)).where("rank = 1")
    return once(selection.fits(panel.risk_factors(lv), monte_carlo.MOVES, orders=orders))


def factor_var(lv: DataFrame) -> DataFrame:
    """VaR at 95% and 99% by factor moves: each factor's model is the one selected on its whole sample."""
    lv = once(lv)
    return monte_carlo.factor_var(lv, selection.selected(factor_fits(lv)).select(S.BOOK, "factor", "model", "law", "p", "q"))


def factor_residuals(lv: DataFrame) -> DataFrame:
    """(book, i, a column for each factor): the residuals of the selected models, days side by side."""
    z = selection.selected(factor_fits(lv)).select(S.BOOK, "factor", F.posexplode("z").alias("i", "z"))
    return z.groupBy(S.BOOK, "i").pivot("factor", sorted(monte_carlo.MOVES)).agg(F.first("z"))


def factor_vine(lv: DataFrame) -> DataFrame:
    """The vine of the residuals, edge by edge."""
    return dependence.vine(factor_residuals(lv), monte_carlo.MOVES)


def vine_fit(lv: DataFrame) -> DataFrame:
    z = once(factor_residuals(lv))
    return dependence.vine_fit(once(dependence.vine(z, monte_carlo.MOVES)), z.groupBy(S.BOOK).agg(F.count("*").alias("n")))


def first_tree(lv: DataFrame) -> DataFrame:
    """The first tree of the vine of the factor moves as they are: the edges of greatest |tau|."""
    d = dependence.vine(panel.risk_factors(lv), monte_carlo.MOVES, ("gaussian",))
    return d.where("tree = 1").select(S.BOOK, "a", "b", "tau")


def copula_checks(lv: DataFrame) -> DataFrame:
    z = once(factor_residuals(lv))
    return dependence.copula_checks(z, sorted(monte_carlo.MOVES))


def simulation_checks(lv: DataFrame) -> DataFrame:
    """The GARCH-copula simulation's draws beside the moves that came, refit by refit."""
    lv = once(lv)
    m = monte_carlo.garch_copula_model(lv, monte_carlo.garch_copula_fits(lv))
    return dependence.simulation_checks(m.rows, m.draw, panel.mc_shocks(lv), panel.SHOCKS)


def scenario_table(lv: DataFrame) -> DataFrame:
    """The t copula's scenarios of every day."""
    return scenarios.table(monte_carlo.t_copula_model(lv))


def sample_day(lv: DataFrame) -> DataFrame:
    """The worst scenarios of the book's last day, and what they are made of."""
    lv = once(lv)
    last = lv.agg(F.max("d").cast("string")).first()[0]
    model = monte_carlo.t_copula_model(lv)
    if not last:
        return scenarios.day_slice(scenarios.table(model), "1970-01-01")
    return scenarios.day_slice(scenarios.table(monte_carlo.Model(model.rows.where(F.col("d") == F.lit(last).cast("date")), model.draw)), last)


def every_method(lv: DataFrame) -> DataFrame:
    """(method, book, d, pnl, var, es): all methods of the registry against the book's P&L. factor_copula is the simulation of factor moves by vines."""
    lv = once(lv)
    pnl, resid = once(total_pnl(lv)), once(_resid(lv))
    factor = factor_var(lv).select(S.BOOK, "d", F.col("var_99").alias("var"))
    parts = {
        "delta_normal": dn_rows(lv), "hist_sim": hist_sim.rolling(lv), "mc_gaussian": monte_carlo.gaussian(lv), "mc_t_copula": monte_carlo.t_copula(lv), "mc_garch_copula": monte_carlo.garch_copula(lv),
        "factor_copula": factor, "evt": evt_var(lv), "garch_evt": garch.garch_evt(resid), "fhs": garch.filtered(resid),
    }
    return once(united({k: against(v, pnl) for k, v in parts.items()}, "method"))


def compare_all(lv: DataFrame) -> DataFrame:
    """All methods beside each other, as a table of text."""
    return backtest.compare(backtest.run(every_method(lv), ("method",)))


def method_backtests(lv: DataFrame) -> DataFrame:
    """All methods' tests, with how deep exceptions go and what the estimates are."""
    return analysis.summarize(every_method(lv), ("method",)).select("method", *TESTS[:-3], "severity", "mean_var", "mean_es", "max_var")


def compare_table(lv: DataFrame) -> DataFrame:
    return backtest.compare(compare_methods(lv))


def registry_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written, then read by their names; one that isn't there is left out."""
    d = once(two_methods(levels(spark, sf_dir)))
    at = fresh_path(spark, "results")
    for name in ("delta_normal", "hist_sim"):
        market.write_result(d.where(F.col("method") == name).select("d", "pnl", "var"), f"{at}/{name}")
    d = market.methods(spark, {k: f"{at}/{k}" for k in ("delta_normal", "hist_sim", "not_there")})
    return rounded(backtest.run(d, ("method",)).select("method", *TESTS))


def summary_stats(lv: DataFrame) -> DataFrame:
    p = once(panel.portfolio_return(lv).select(S.BOOK, "i", "x"))
    return p.groupBy(S.BOOK).agg(*(v.alias(k) for k, v in analysis.summary_stats("x").items())).join(diagnostics.ks_normal(p, "x").drop("n"), S.BOOK)


def static_var(lv: DataFrame) -> DataFrame:
    d = book.pnl(lv)
    return analysis.static_var(d, "pnl_total", {0.95: Z_95, S.ALPHA: S.Z_ALPHA})


def adequacy(lv: DataFrame) -> DataFrame:
    d = garch_fixed(lv)
    return diagnostics.portmanteau(d, {"r": F.col("r"), "z": F.col("z"), "z2": F.col("z") * F.col("z")})


def region_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta-normal VaR of several books, each a series of its own."""
    d = delta_normal.rolling(panel.levels(market.lineitem_panel(spark, sf_dir, books="region")), 250)
    return rounded(d.select(S.BOOK, "d", "i", "x", "var_full", "es_full", "mu", "sigma"), 4)


def calendar(how: str) -> Callable:
    return lambda spark, sf_dir: panel.date_set(levels(spark, sf_dir), market.orders_index(spark, sf_dir), how)


def shock_fits(lv: DataFrame) -> DataFrame:
    """GARCH(1,1) with t innovations of each shock."""
    return selection.fits(panel.mc_shocks(lv), panel.SHOCKS, ("garch",), ("std",))


def judged_fits(lv: DataFrame) -> DataFrame:
    """The criteria of each factor's selected model."""
    return selection.criteria(selection.selected(factor_fits(lv)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    losses = lambda f: lambda lv: f(portfolio_losses(lv))
    return {
        "delta_normal_var": _of(delta_normal.rolling, 4),
        "panel_ffill_limit": _of(lambda lv: lv, 6),
        "asof_levels": asof_levels,
        "log_returns": _of(panel.log_returns, 8),
        "factor_shocks_hist": _of(panel.hist_shocks, 8),
        "factor_shocks_mc": _of(panel.mc_shocks, 8),
        "risk_factors": _of(panel.risk_factors, 6),
        "portfolio_return": _of(lambda lv: panel.portfolio_return(lv).select(S.BOOK, "d", "x"), 8),
        "price_index": _of(panel.price_index, 6),
        "straddle_state": _of(lambda lv: book.straddle_state(lv).select(S.BOOK, "d", "i", "strike", "tenor", "days_held", "rolled"), 8),
        "inception_shares": _of(lambda lv: book.shares(lv).select(S.BOOK, "d", *(f"sh_{c[-1]}" for c in S.ASSETS)), 8),
        "irs_price_dv01": irs_grid,
        "straddle_price_greeks": _of(straddle_greeks, 6),
        "instrument_pnl": _of(lambda lv: book.pnl(lv).select(S.BOOK, "d", "pnl_irs", "pnl_straddle"), 3),
        "total_pnl": _of(book.pnl, 3),
        "delta_normal_windows": _of(delta_normal_windows, 6),
        "delta_normal_linear": _of(lambda lv: backtest.run(dn_linear(lv)).select(S.BOOK, *TESTS), 8),
        "delta_normal_ewma_tests": _of(delta_normal_ewma_tests, 5),
        "delta_normal_diag_tests": _of(delta_normal_diag_tests, 5),
        "delta_normal_ewma": _of(lambda lv: delta_normal.ewma(lv, 0.94).unionByName(delta_normal.ewma(lv, 0.97)), 4),
        "delta_normal_diag": _of(delta_normal.diagonal, 4),
        "delta_normal_crisis": _of(delta_normal_crisis, 6),
        "crisis_table": _of(crisis_methods, 5),
        "crisis_table_tails": _of(crisis_tails, 5),
        "hist_sim_var": _of(lambda lv: hist_sim.rolling(lv).select(*HS_COLUMNS), 3),
        "hist_sim_components": _of(lambda lv: hist_sim.components(lv).select("d", "snapshot_d", "component", "var", "es", "tail_scenarios", "realised_pnl", "realised_loss", "exception"), 3),
        "hist_sim_component_summary": _of(component_summary, 5),
        "hist_sim_tail_usage": _of(lambda lv: hist_sim.tail_usage(lv).drop("f"), 3),
        "hist_sim_tail_summary": _of(lambda lv: analysis.tail_summary(hist_sim.tail_usage(lv)), 3),
        "hist_sim_extreme_days": _of(extreme_days, 3),
        "hist_sim_subperiods": _of(hist_subperiods, 5),
        "hist_sim_windows": _of(hist_windows, 5),
        "vol_adjusted_hs": _of(lambda lv: hist_sim.vol_adjusted(lv).select(*HS_COLUMNS, "avg_vol_ratio"), 3),
        "rolling_quantile_var": _of(losses(lambda x: x.withColumn("q", diagnostics.rolling_quantile(x, "loss", S.ALPHA)).where(F.col("i") > S.WINDOW).select(S.BOOK, "d", "q")), 3),
        "empirical_es": _of(losses(diagnostics.empirical_var_es), 3),
        "pot_threshold_counts": _of(losses(diagnostics.tail_counts), 3),
        "pot_formula_fixed_params": _of(pot_fixed, 3),
        "garch_recursion_fixed_params": _of(garch_fixed, 8),
        "volatility_recursions": _of(volatility_recursions, 8),
        "factor_pnl": _of(lambda lv: book.factor_pnl(book.factor_moves(lv)), 3),
        "factor_reconstruction": _of(book.reconstruction, 6),
        "fhs_fixed_params": _of(fhs_fixed, 3),
        "ewma_corr_fixed": _of(ewma_correlation, 8),
        "exceptions": _of(lambda lv: with_exceptions(lv).select(S.BOOK, "d", "pnl", "var", "exception"), 4),
        "kupiec": _of(lambda lv: backtest.run(dn_backtest(lv)).select(S.BOOK, "t", "n", "lr_uc", "p_uc"), 8),
        "christoffersen": _of(lambda lv: backtest.run(dn_backtest(lv)).select(S.BOOK, "n00", "n01", "n10", "n11", "lr_ind", "p_ind"), 8),
        "binomial_range": _of(lambda lv: backtest.run(dn_backtest(lv)).select(S.BOOK, "t", "n", "lower", "upper", "binomial_p", "binomial_reject"), 8),
        "run_backtest": _of(lambda lv: backtest.run(dn_backtest(lv)).select(S.BOOK, *TESTS), 8),
        "strict_backtest": _of(lambda lv: backtest.degenerate_as_null(backtest.run(dn_backtest(lv)), 1 - S.ALPHA).select(S.BOOK, "lr_uc_strict", "lr_ind_strict"), 8),
        "compare_methods": _of(compare_methods, 6),
        "exceptions_by_year": _of(lambda lv: backtest.by_year(with_exceptions(lv)), 8),
        "cumulative_exceptions": _of(lambda lv: backtest.cumulative(with_exceptions(lv)), 6),
        "exception_severity": _of(lambda lv: with_exceptions(lv).groupBy(S.BOOK).agg(backtest.severity().alias("severity")), 4),
        "moments_quantiles": _of(moments, 4),
        "mean_excess_curve": _of(losses(lambda x: diagnostics.mean_excess(x, [k / 20 for k in range(20)])), 3),
        "hill_curve": _of(losses(diagnostics.hill), 8),
        "pseudo_observations": _of(pseudo_obs, 8),
        "copula_corr": _of(lambda lv: diagnostics.correlations(pseudo_obs(lv), [f"u_{c}" for c in RETURNS]), 8),
        "joint_tail_prob": _of(lambda lv: diagnostics.joint_tails(pseudo_obs(lv), [f"u_{c}" for c in RETURNS]), 8),
        "ljung_box_stat": _of(lambda lv: diagnostics.ljung_box(panel.portfolio_return(lv), "x"), 6),
        "ks_normal_stat": _of(lambda lv: diagnostics.ks_normal(panel.portfolio_return(lv), "x"), 8),
        "ks_two_sample_stat": _of(lambda lv: diagnostics.ks_two(panel.portfolio_return(lv), "x", F.col("i") % 2 == 0), 8),
        "sign_bias_ols": _of(lambda lv: diagnostics.sign_bias(garch_fixed(lv), "z"), 4),
        "pnl_component_corr": _of(lambda lv: diagnostics.correlations(book.pnl(lv), [f"pnl_{c}" for c in S.COMPONENTS]), 8),
        "param_stability": _of(param_stability, 3),
        "stress_worst_n": _of(stress_worst, 3),
        "factor_taus": _of(lambda lv: dependence.taus(panel.risk_factors(lv), monte_carlo.MOVES), 8),
        "vine_first_tree": _of(first_tree, 8),
        "tail_dependence": _of(lambda lv: dependence.tail_dependence(pseudo_obs(lv), [f"u_{c}" for c in RETURNS]), 8),
        "weighted_portmanteau": _of(lambda lv: diagnostics.weighted_portmanteau(garch_fixed(lv), {"z": F.col("z"), "z2": F.col("z") * F.col("z")}), 6),
        "adequacy_ljung_box": _of(adequacy, 6),
        "sign_bias_test": _of(lambda lv: diagnostics.sign_bias_test(garch_fixed(lv), "z"), 6),
        "innovation_quantiles": _of(lambda lv: diagnostics.quantiles_type8(garch_fixed(lv), "z", US), 8),
        "static_var_es": _of(static_var, 3),
        "rolling_moments": _of(lambda lv: analysis.rolling_moments(panel.portfolio_return(lv), "x"), 8),
        "summary_stats": _of(summary_stats, 6),
        "compare_table": _of(compare_table),
        "pricing_validation": _of(lambda lv: validation.pnl_twice(once(lv)).where("not endswith(part, '_simulated')").drop("allowed"), 3),
        "parameter_stability_counts": _of(stability_counts, 3),
        "found_estimates": found_estimates,
        "registry_backtest": registry_backtest,
        "region_books": region_books,
        "dates_in_both": calendar("intersect"),
        "dates_in_panel_only": calendar("except"),
        "panel_violations": _of(panel.violations),
        "raw_panel_violations": lambda spark, sf_dir: panel.violations(market.lineitem_panel(spark, sf_dir)),
        "delta_t_normal": _of(delta_t_normal, 4),
        "delta_t_normal_tests": _of(delta_t_normal_tests, 5),
        "evt_var": _of(evt_var, 4),
        "evt_stability": _of(evt_stability, 6),
        "garch_stability": _of(garch_stability, 8),
        "pricing_validation_summary": _of(lambda lv: validation.summary(validation.pnl_twice(once(lv))), 9),
        "pricing_validation_worst": _of(lambda lv: validation.worst(validation.pnl_twice(once(lv))), 9),
        "delta_normal_violations": _of(dn_violations, 4),
        "garch_evt_violations": _of(garch_evt_violations, 4),
        "evt_violations": _of(lambda lv: tails.invariants(evt_var(lv)), 4),
        "evt_threshold_windows": _of(evt_grid, 6),
        "garch_fit": _of(garch_params, 6),
        "garch_factors": _of(lambda lv: shock_fits(lv).drop("z", "ar", "ma"), 6),
        "arma_orders": _of(lambda lv: factor_orders(lv).drop("ar", "ma"), 6),
        "garch_comparison": _of(lambda lv: factor_fits(lv).drop("z", "ar", "ma"), 6),
        "garch_selection": _of(lambda lv: selection.selected(factor_fits(lv)).drop("z", "ar", "ma"), 6),
        "garch_criteria": _of(judged_fits, 6),
        "garch_summary_table": _of(lambda lv: selection.summary_table(judged_fits(lv))),
        "garch_variance_table": _of(lambda lv: selection.variance_table(judged_fits(lv))),
        "garch_candidates": _of(lambda lv: selection.candidates(factor_fits(lv)), 6),
        "vine_edges": _of(factor_vine, 6),
        "vine_fit": _of(vine_fit, 4),
        "copula_checks": _of(copula_checks, 6),
        "simulation_checks": _of(simulation_checks, 6),
        "garch_evt_thresholds": _of(garch_thresholds, 6),
        "garch_compare": _of(garch_compare, 6),
        "refit_sweep": _of(refit_sweep, 6),
        "window_sweep": _of(window_sweep, 6),
        "compare_all_methods": _of(compare_all),
        "method_backtests": _of(method_backtests, 5),
        "sign_bias_p": _of(lambda lv: diagnostics.with_p(diagnostics.sign_bias_test(garch_fixed(lv), "z")), 6),
        "arch_lm": _of(lambda lv: diagnostics.arch_lm(garch_fixed(lv), "z"), 6),
        "adf": _of(lambda lv: diagnostics.dickey_fuller(once(panel.portfolio_return(lv)), "x"), 6),
        "residual_families": _of(lambda lv: selection.residual_families(selection.selected(factor_fits(lv))), 6),
        "garch_evt_var": _of(garch_evt_var, 4),
        "garch_evt_rolling": _of(garch_challenger, 4),
        "fhs_var": _of(fhs_var, 4),
        "mc_factor_var": _of(factor_var, 2),
        "scenario_var": _of(lambda lv: scenarios.figures(scenario_table(lv)), 2),
        "scenario_shares": _of(lambda lv: scenarios.shares(scenario_table(lv)), 4),
        "sample_day": _of(sample_day, 4),
        "mc_gaussian_var": _of(monte_carlo.gaussian, 2),
        "mc_t_copula_var": _of(monte_carlo.t_copula, 2),
        "mc_garch_copula_var": _of(monte_carlo.garch_copula, 2),
        "copula_gof_cvm": _of(monte_carlo.copula_gof, 6),
    }
