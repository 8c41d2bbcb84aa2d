"""Prices as Column expressions: they stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

#: Numerator and denominator of the normal upper tail's rational approximation, highest power first.
TAIL_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_CUT = 7.07106781186547


def _horner(coefficients, z):
    return reduce(lambda acc, c: acc * z + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution function, to about 1e-15. Give it a plain column: it stands in the result many times."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    far = e / (z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + F.lit(0.65)))))) / F.lit(2.506628274631)
    tail = F.when(z < TAIL_CUT, e * _horner(TAIL_NUM, z) / _horner(TAIL_DEN, z)).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def chi2_tail(x: Column, df: int) -> Column:
    """1 - distribution function of chi-squared, for 1 or 2 degrees of freedom."""
    return F.exp(-x / 2) if df == 2 else 2 * (1 - norm_cdf(F.sqrt(x)))


def annuity(rate: Column, years: int = S.IRS_YEARS, per_year: int = 1) -> Column:
    """The present value of payments of 1 / period, summed (right at rate 0 too)."""
    v = 1 / (1 + rate / per_year)
    return v * reduce(lambda acc, _: 1 + v * acc, range(years * per_year - 1), F.lit(1.0))


def irs_value(rate: Column, notional: float = S.IRS_NOTIONAL, fixed: float = S.IRS_FIXED) -> Column:
    return notional * (rate - fixed) * annuity(rate)


def irs_dv01(rate: Column, notional: float = S.IRS_NOTIONAL) -> Column:
    return notional * annuity(rate) * 1e-4


def with_straddle(df: DataFrame, out: str, spot: Column, strike: Column, tenor: Column, rate: Column, vol: Column, greeks: bool = False) -> DataFrame:
    """df with the value of a call and a put in column `out`; at or past expiry |spot - strike|. With greeks: out_delta, _gamma, _vega and _theta,
    defined before expiry."""
    n = lambda x: f"_{out}_{x}"
    given = {n("s"): spot, n("k"): strike, n("t"): tenor, n("r"): rate, n("v"): F.greatest(vol, F.lit(S.MIN_VOL))}
    df = df.withColumns(given)
    s, k, t, r, v = (F.col(c) for c in given)
    live = F.when(t > 0, t)
    df = df.withColumn(n("w"), v * F.sqrt(live)).withColumn(n("f"), k * F.exp(-r * live))
    df = df.withColumn(n("d1"), (F.log(s / k) + (r + v * v / 2) * live) / F.col(n("w")))
    df = df.withColumn(n("d2"), F.col(n("d1")) - F.col(n("w")))
    df = df.withColumns({n("n1"): norm_cdf(F.col(n("d1"))), n("n2"): norm_cdf(F.col(n("d2")))})
    n1, n2, f, w = (F.col(n(x)) for x in ("n1", "n2", "f", "w"))
    cols = {out: F.when(t > 0, s * (2 * n1 - 1) - f * (2 * n2 - 1)).otherwise(F.abs(s - k))}
    if greeks:
        pdf = norm_pdf(F.col(n("d1")))
        cols |= {
            f"{out}_delta": 2 * n1 - 1,
            f"{out}_gamma": 2 * pdf / (s * w),
            f"{out}_vega": 2 * s * pdf * F.sqrt(live),
            f"{out}_theta": (-s * pdf * v / F.sqrt(live) - r * f * (2 * n2 - 1)) / S.TRADING_DAYS,
        }
    return df.withColumns(cols).drop(*given, *(n(x) for x in ("w", "f", "d1", "d2", "n1", "n2")))
