"""GARCH volatility, filtered and extreme-value VaR on it.

Parameters are refitted every `every` days on all data before (or the window before): each refit is a task of its own. Between refits a day's
variance follows from the day before: a fold over the segment's returns, segment by segment in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from . import tails
from .once import dealt, once
from .panel import frame

REFIT = 50
FIT_SCHEMA = "book string, refit int, t long, mu double, omega double, alpha double, beta double, nu double, loglik double, next double, sigma array<double>"


def refits(r: DataFrame, window: int = S.WINDOW, every: int = REFIT, rolling: bool = False) -> DataFrame:
    """A fit for each refit day t = window, window + every, ...: returns (book, i, r) with i from 0, taken in units of their sample's deviation for the fit. sigma:
    the sample's volatilities, kept for its last `window` days."""
    n = r.groupBy(S.BOOK).agg(F.max("i").alias("last"))
    days = n.select(S.BOOK, F.explode(F.sequence(F.lit(window), F.col("last"), F.lit(every))).alias("t"))
    days = days.withColumn("refit", ((F.col("t") - window) / every).cast("int"))
    series = r.groupBy(S.BOOK).agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("s"))
    # each refit gets its own slice of the series, so the fits are dealt one by one
    own = days.join(series, S.BOOK).withColumn("x", F.transform(F.slice("s", F.greatest(F.col("t") - window, F.lit(0)) + 1 if rolling else F.lit(1), F.lit(window) if rolling else F.col("t")), lambda v: v["r"])).drop("s", "last")

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                x = np.asarray(row.x, float)
                scale = 1 / (x.std() or 1.0)
                f = K.garch_fit(x * scale)
                out.append((row.book, row.refit, row.t, f["mu"] / scale, f["omega"] / scale**2, f["alpha"], f["beta"], f["nu"], f["loglik"], f["next"] / scale**2, (f["sigma"][-window:] / scale).tolist()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FIT_SCHEMA.split(", ")])

    return dealt(own, S.BOOK, "t").mapInPandas(run, FIT_SCHEMA)


def fold(omega: Column, alpha: Column, beta: Column, first: Column, squares: Column) -> Column:
    """The variance after the squared innovations of an array, from `first`."""
    return F.aggregate(squares, first, lambda s, e2: F.greatest(omega + alpha * e2 + beta * s, F.lit(1e-10)))


def advance(model: str, sigma: Column, e: Column, omega: float, alpha: float, beta: float, gamma: float = 0.0, delta: float = 2.0) -> Column:
    """The volatility after residual e: `garch`, `gjr` (gamma for falls) or `aparch` (a power delta of the volatility, gamma its asymmetry)."""
    if model == "aparch":
        size = F.greatest(F.abs(e) - gamma * e, F.lit(1e-12))
        power = omega + alpha * F.pow(size, F.lit(delta)) + beta * F.pow(F.greatest(sigma, F.lit(1e-6)), F.lit(delta))
        return F.greatest(F.pow(F.greatest(power, F.lit(1e-12)), F.lit(1 / delta)), F.lit(1e-6))
    falls = F.when(e < 0, gamma).otherwise(0.0) if model == "gjr" else F.lit(0.0)
    return F.sqrt(F.greatest(omega + (alpha + falls) * e * e + beta * F.greatest(sigma * sigma, F.lit(1e-12)), F.lit(1e-12)))


def guarded(fits: DataFrame, most: float = 0.999) -> DataFrame:
    """fits with near-integrated ones (alpha + beta >= most) given the last valid parameters before; reverted tells which."""
    ok = F.col("alpha") + F.col("beta") < most
    w = Window.partitionBy(S.BOOK).orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    p = F.last(F.when(ok, F.struct("mu", "omega", "alpha", "beta")), ignorenulls=True).over(w)
    d = fits.withColumn("_p", F.coalesce(p, F.struct("mu", "omega", "alpha", "beta"))).withColumn("reverted", ~ok)
    return d.withColumns({c: F.col(f"_p.{c}") for c in ("mu", "omega", "alpha", "beta")}).drop("_p")


def volatility(r: DataFrame, fits: DataFrame, window: int = S.WINDOW, every: int = REFIT) -> DataFrame:
    """(book, d, i, r, refit, mu, sigma, z): each day's forecast volatility and residual. A segment starts from its fit's own forecast; a
    reverted one from its stationary variance."""
    d = r.where(F.col("i") >= window).withColumn("refit", ((F.col("i") - window) / every).cast("int"))
    d = d.join(guarded(fits).select(S.BOOK, "refit", "mu", "omega", "alpha", "beta", "nu", "next", "reverted"), [S.BOOK, "refit"])
    seg = Window.partitionBy(S.BOOK, "refit").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("reverted"), F.col("omega") / F.greatest(1 - F.col("alpha") - F.col("beta"), F.lit(1e-6))).otherwise(F.col("next"))
    d = d.withColumn("_e", F.collect_list(F.pow(F.col("r") - F.col("mu"), 2)).over(seg))
    d = d.withColumn("sigma", F.sqrt(fold(F.col("omega"), F.col("alpha"), F.col("beta"), F.greatest(start, F.lit(1e-10)), F.col("_e")))).drop("_e")
    return d.withColumn("z", (F.col("r") - F.col("mu")) / F.col("sigma")).select(S.BOOK, "d", "i", "r", "refit", "mu", "sigma", "z")


def residuals(r: DataFrame, fits: DataFrame, window: int = S.WINDOW, every: int = REFIT) -> DataFrame:
    """volatility(), with the days before the first forecast filled from the first fit's sample. The fits are made once."""
    fits = once(fits)
    out = volatility(r, fits, window, every)
    first = fits.where("refit = 0").select(S.BOOK, "mu", F.posexplode("sigma").alias("i", "sigma")).withColumn("i", F.col("i").cast("long"))
    early = r.join(first, [S.BOOK, "i"]).withColumn("z", (F.col("r") - F.col("mu")) / F.col("sigma"))
    return out.unionByName(early.select(S.BOOK, "d", "i", "r", F.lit(-1).alias("refit"), "mu", "sigma", "z"))


def garch_evt(resid: DataFrame, window: int = S.WINDOW, qs=(0.9,), alpha: float = S.ALPHA, v0: float = S.V0) -> DataFrame:
    """VaR = v0 (sigma * tail quantile of -z - mu), not under 0; ES not under VaR. A row for each day and threshold q."""
    d = tails.windows(resid.withColumn("loss", -F.col("z")), "loss", window).where("refit >= 0")
    d = d.select(S.BOOK, "d", "i", "r", "mu", F.col("sigma").alias("vol"), "w", F.explode(F.array(*map(F.lit, qs))).alias("q"))
    p = tails.fit(d, "q", alpha, floor=False)
    var = F.greatest(v0 * (F.col("vol") * F.col("var") - F.col("mu")), F.lit(0.0))
    p = p.withColumns({"q_z": F.col("var"), "es_z": F.col("es"), "var": var})
    return p.withColumn("es", F.greatest(v0 * (F.col("vol") * F.col("es_z") - F.col("mu")), F.col("var")))


def filtered(resid: DataFrame, window: int = S.WINDOW, p: float = 1 - S.ALPHA, v0: float = S.V0) -> DataFrame:
    """Filtered historical simulation: minus the p-quantile of v0 * sigma * (the last `window` residuals), without the mean."""
    w = frame(-window, -1)
    d = resid.withColumns({"_q": F.percentile("z", p).over(w), "_n": F.count("z").over(w)}).where((F.col("_n") == window) & (F.col("refit") >= 0))
    return d.select(S.BOOK, "d", "i", "r", "sigma", (-v0 * F.col("sigma") * F.col("_q")).alias("var"))
