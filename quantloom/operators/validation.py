"""The book's P&L a second time: by a loop over the days and exact distribution functions, beside the column expressions; and the simulations' pricers,
which read a table of the normal law, beside these."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from . import book

#: Money by which a day's P&L may differ: values are of the order of 1e8, and doubles have 15 or 16 places.
TOLERANCE = 1e-6
#: Error of the simulations' normal law: a linear table of this step, where the density's slope is 0.242 at most.
TABLE_STEP = 18 / 36_000
TABLE_ERROR = TABLE_STEP**2 / 8 * 0.242
PARTS = ("linear", "irs", "straddle", "total", "irs_simulated", "straddle_simulated")


def _straddle(s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A call by its formula, a put by parity."""
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    paid = k * np.exp(-r * t)
    call = s * K.norm_cdf(d1) - paid * K.norm_cdf(d1 - v * np.sqrt(t))
    return 2 * call - s + paid


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """A book's days, in order -> (book, d, part, again, allowed): each part's P&L from the second day, and how far it may be off."""
    pdf = pdf.sort_values("i")
    px, points = pdf[list(S.ASSETS)].to_numpy(float), pdf["rate_idx"].to_numpy(float) / 100
    spot, vol, floored = pdf[S.UNDERLYING].to_numpy(float), pdf["vol_idx"].to_numpy(float) / 100, np.maximum(points, 0.0)
    strike, tenor, held = np.empty(len(pdf)), np.empty(len(pdf)), S.STRADDLE_DAYS
    for t in range(len(pdf)):
        if held == S.STRADDLE_DAYS:
            k, held = spot[t], 0
        strike[t], tenor[t] = k, max(S.STRADDLE_DAYS - held, 1) / S.TRADING_DAYS
        held += 1
    paid = sum((1 + points) ** -float(y) for y in range(1, S.IRS_YEARS + 1))
    value = {
        "linear": px @ (S.V0 * S.WEIGHT / px[0]),
        "irs": S.IRS_NOTIONAL * (points - S.IRS_FIXED) * paid,
        "straddle": S.STRADDLE_SHARES * _straddle(spot, strike, tenor, floored, vol),
        "irs_simulated": K.irs(points, S.IRS_NOTIONAL, S.IRS_FIXED, S.IRS_YEARS),
        "straddle_simulated": S.STRADDLE_SHARES * K.straddle(spot, strike, tenor, floored, vol),
    }
    moved = {p: np.diff(v) for p, v in value.items()}
    moved["total"] = moved["linear"] + moved["irs"] + moved["straddle"]
    exposed = S.STRADDLE_SHARES * 2 * (spot + strike)  # each of two prices has two values of the law, doubled
    allowed = dict.fromkeys(PARTS, TOLERANCE) | {"straddle_simulated": TOLERANCE + TABLE_ERROR * (exposed[1:] + exposed[:-1])}
    days = pdf["d"].iloc[1:]
    return pd.concat([pd.DataFrame({S.BOOK: pdf[S.BOOK].iloc[0], "d": days, "part": p, "again": moved[p], "allowed": allowed[p]}) for p in PARTS])


def pnl_twice(lv: DataFrame) -> DataFrame:
    """(book, d, part, own, again, allowed, abs_err) for each day from the second: the P&L of book.pnl and the second one. A book is one group, as everywhere; a
    part that ends in _simulated holds the simulations' pricer against the book's. A null level makes its days' differences null; no day, no row."""
    own = book.pnl(lv)
    of = {p: F.col(f"pnl_{p.removesuffix('_simulated')}") for p in PARTS}
    own = own.select(S.BOOK, "d", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), c.alias("own")) for p, c in of.items()])))
    again = lv.select(S.BOOK, "d", "i", *S.ASSETS, "vol_idx", "rate_idx").groupBy(S.BOOK).applyInPandas(_again, f"{S.BOOK} string, d date, part string, again double, allowed double")
    return own.join(again, [S.BOOK, "d", "part"], "left").withColumn("abs_err", F.abs(F.col("own") - F.col("again")))


def summary(twice: DataFrame) -> DataFrame:
    """(part, days, max_err, mean_err, passed): passed if every day has a second value within what is allowed."""
    ok = F.min(F.coalesce(F.col("abs_err") <= F.col("allowed"), F.lit(False)))
    return twice.groupBy("part").agg(F.count("*").alias("days"), F.max("abs_err").alias("max_err"), F.avg("abs_err").alias("mean_err"), ok.alias("passed"))


def worst(twice: DataFrame, n: int = 10) -> DataFrame:
    """The n days on which the totals differ most: a top-k report."""
    return twice.where("part = 'total'").orderBy(F.desc("abs_err"), "d").limit(n)
