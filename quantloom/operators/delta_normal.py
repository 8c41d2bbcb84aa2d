"""Delta-normal VaR and ES. e'Se of the asset covariance is the sample variance of the weighted return, so one windowed variance is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .panel import frame, portfolio_return

ES_FACTOR = S.PHI_ALPHA / (1 - S.ALPHA)


def estimates(sigma: Column, mu: Column, z: float = S.Z_ALPHA, es: float = ES_FACTOR) -> dict[str, Column]:
    return {"var_full": z * sigma - mu, "var_nodrift": z * sigma, "es_full": es * sigma - mu, "es_nodrift": es * sigma, "mu": mu, "sigma": sigma}


def _ready(window: int) -> Column:
    return F.col("i") > window


def rolling(lv: DataFrame, window: int = S.WINDOW, z: float = S.Z_ALPHA, es: float = ES_FACTOR, v0: float = S.V0) -> DataFrame:
    """(book, d, i, x, var_full, var_nodrift, es_full, es_nodrift, mu, sigma), for days with a full window before them."""
    w = frame(-window, -1)
    d = portfolio_return(lv).withColumns({"_m": v0 * F.avg("x").over(w), "_s": v0 * F.sqrt(F.var_samp("x").over(w))}).where(_ready(window))
    return d.select(S.BOOK, "d", "i", "x", *(c.alias(k) for k, c in estimates(F.col("_s"), F.col("_m"), z, es).items()))


def ewma(lv: DataFrame, lam: float, window: int = S.WINDOW, v0: float = S.V0) -> DataFrame:
    """Variance weighted by lam**age, weights summing to 1, about the plain window mean; x comes as an array of the window, newest last."""
    w = frame(-window, -1)
    d = portfolio_return(lv).withColumns({"_m": F.avg("x").over(w), "_a": F.collect_list("x").over(w)}).where(_ready(window))
    total = (1 - lam**window) / (1 - lam)
    # oldest first: acc * lam + term leaves lam**age on each
    fold = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc * F.lit(lam) + (x - F.col("_m")) * (x - F.col("_m")))
    d = d.withColumn("_s", v0 * F.sqrt(fold / total)).withColumn("_m", v0 * F.col("_m"))
    return d.select(S.BOOK, "d", "i", F.lit(lam).alias("lam"), "x", *(c.alias(k) for k, c in estimates(F.col("_s"), F.col("_m")).items()))


def diagonal(lv: DataFrame, window: int = S.WINDOW, v0: float = S.V0) -> DataFrame:
    """Full and diagonal covariance side by side, and their difference."""
    w = frame(-window, -1)
    d = portfolio_return(lv)
    diag = sum(S.WEIGHT**2 * F.var_samp(f"r_{c[-1]}").over(w) for c in S.ASSETS)
    d = d.withColumns({"_m": v0 * F.avg("x").over(w), "sigma_full": v0 * F.sqrt(F.var_samp("x").over(w)), "sigma_diagonal": v0 * F.sqrt(diag)}).where(_ready(window))
    cols = {}
    for k in ("full", "diagonal"):
        cols |= {f"var_{k}": S.Z_ALPHA * F.col(f"sigma_{k}") - F.col("_m"), f"es_{k}": ES_FACTOR * F.col(f"sigma_{k}") - F.col("_m")}
    d = d.withColumns(cols).withColumn("benefit", F.col("var_diagonal") - F.col("var_full"))
    return d.select(S.BOOK, "d", "i", "x", *cols, "sigma_full", "sigma_diagonal", "benefit")
