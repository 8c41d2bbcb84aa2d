"""The book: straddle state, inception shares, values and P&L by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.pricing import irs_value, with_straddle
from .panel import before, log_return, rows


def straddle_state(lv: DataFrame, days: int = S.STRADDLE_DAYS) -> DataFrame:
    """lv with strike, tenor (years), days_held and rolled of a straddle struck at the money every `days` rows: closed in i, no loop."""
    roll = Window.partitionBy(S.BOOK, F.floor(F.col("i") / days)).orderBy("i")
    held = F.col("i") % days
    return lv.withColumns({
        "strike": F.first(S.UNDERLYING).over(roll),
        "tenor": F.greatest((days - held) / F.lit(float(S.TRADING_DAYS)), F.lit(1.0 / S.TRADING_DAYS)),
        "days_held": held,
        "rolled": (F.col("i") > 0) & (held == 0),
    })


def shares(lv: DataFrame, v0: float = S.V0) -> DataFrame:
    """lv with sh_a ...: v0 * weight / first price, fixed at inception."""
    return lv.withColumns({f"sh_{c[-1]}": v0 * S.WEIGHT / F.first(c).over(rows()) for c in S.ASSETS})


def linear_value(prices: dict[str, Column] | None = None) -> Column:
    return sum(F.col(f"sh_{c[-1]}") * (prices[c] if prices else F.col(c)) for c in S.ASSETS)


def rate(points: Column, clip: bool = True) -> Column:
    return F.greatest(points / 100, F.lit(0.0)) if clip else points / 100


def values(lv: DataFrame) -> DataFrame:
    """lv with shares, state and v_linear, v_irs, v_straddle at its levels (rates not under 0)."""
    d = straddle_state(shares(lv))
    d = d.withColumn("_rate", rate(F.col("rate_idx")))
    d = d.withColumns({"v_linear": linear_value(), "v_irs": irs_value(F.col("_rate"))})
    d = with_straddle(d, "v_straddle", F.col(S.UNDERLYING), F.col("strike"), F.col("tenor"), F.col("_rate"), F.col("vol_idx") / 100)
    return d.withColumn("v_straddle", F.col("v_straddle") * S.STRADDLE_SHARES).drop("_rate")


def pnl(lv: DataFrame) -> DataFrame:
    """(book, d, i, pnl_linear, pnl_irs, pnl_straddle, pnl_total) from the second day; the swap's rate isn't clipped, the straddle's is."""
    d = values(lv).withColumn("v_irs", irs_value(rate(F.col("rate_idx"), clip=False)))
    d = d.withColumns({f"pnl_{c}": F.col(f"v_{c}") - before(f"v_{c}") for c in S.COMPONENTS}).where("i > 0")
    return d.select(S.BOOK, "d", "i", "pnl_linear", "pnl_irs", "pnl_straddle", (F.col("pnl_linear") + F.col("pnl_irs") + F.col("pnl_straddle")).alias("pnl_total"))


def factor_moves(lv: DataFrame) -> DataFrame:
    """(book, d, i, factor moves, state of the day before): what factor_pnl takes, of the moves that came."""
    change = lambda c: F.col(c) - before(c)
    day = F.lit(1.0 / S.TRADING_DAYS)
    d = straddle_state(lv).withColumns({
        "d_log": log_return("px_d"), "b_log": log_return("px_b"), "a_log": log_return("px_a"), "rate_chg": change("rate_idx"), "vol_chg": change("vol_idx"),
        "spot": before(S.UNDERLYING), "k": before("strike"), "t": F.greatest(before("tenor") - day, day), "r": before("rate_idx") / 100, "v": before("vol_idx"),
    })
    return d.where("i > 0").select(S.BOOK, "d", "i", "d_log", "b_log", "a_log", "rate_chg", "vol_chg", "spot", "k", "t", "r", "v")


def factor_pnl(moves: DataFrame, notional: float = S.V0 * S.WEIGHT) -> DataFrame:
    """(book, d, i, pnl_linear, pnl_irs, pnl_straddle, pnl_total) of factor moves on a state: three assets by notional and log return, the swap and
    the straddle repriced; the same move of the underlying serves both legs. r is a fraction, v and vol_chg are points."""
    c = F.col
    d = moves.withColumns({"_r": c("r") + c("rate_chg") / 100, "_v": F.greatest((c("v") + c("vol_chg")) / 100, F.lit(S.MIN_VOL))})
    d = with_straddle(d, "_p0", c("spot"), c("k"), c("t"), c("r"), c("v") / 100)
    d = with_straddle(d, "_p1", c("spot") * F.exp("d_log"), c("k"), c("t"), c("_r"), c("_v"))
    d = d.withColumns({
        "pnl_linear": notional * (c("d_log") + c("b_log") + c("a_log")), "pnl_irs": irs_value(c("_r")) - irs_value(c("r")), "pnl_straddle": S.STRADDLE_SHARES * (c("_p1") - c("_p0")),
    })
    return d.select(S.BOOK, "d", "i", "pnl_linear", "pnl_irs", "pnl_straddle", (c("pnl_linear") + c("pnl_irs") + c("pnl_straddle")).alias("pnl_total"))


def reconstruction(lv: DataFrame, least: float = 0.95) -> DataFrame:
    """(book, n, corr, passed): how far the P&L by factors follows the book's own."""
    own = pnl(lv).select(S.BOOK, "i", F.col("pnl_total").alias("own"))
    g = factor_pnl(factor_moves(lv)).join(own, [S.BOOK, "i"]).groupBy(S.BOOK).agg(F.count("*").alias("n"), F.corr("pnl_total", "own").alias("corr"))
    return g.withColumn("passed", F.col("corr") >= least)
