"""Historical simulation with full repricing.

A day's scenarios are the shocks of the `window` days before it, met by an equi-join on (book, ordinal): each snapshot is exploded to the
ordinals that it needs. Snapshots are dealt by (book, day) first, so the aggregation by day needs no further shuffle.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.pricing import irs_value, with_straddle
from .book import linear_value, rate, values
from .once import dealt, once
from .panel import SHOCKS, frame, hist_shocks, rows

#: A table of shocks of so many rows at most is sent to all executors; a larger one is joined by shuffle.
SEND_ROWS = 200_000


def tail_count(n: int, alpha: float) -> int:
    """max(1, ceil(n * (1 - alpha))), in decimals."""
    return max(1, int((Decimal(n) * (1 - Decimal(str(alpha)))).to_integral_value(rounding=ROUND_CEILING)))


def worst(losses: Column, k: int) -> dict[str, Column]:
    """VaR and ES of an array of losses: the least of the worst k, and their mean."""
    top = F.slice(F.sort_array(losses, asc=False), 1, k)
    return {"var": F.element_at(top, k), "es": F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / k}


def _horizon(d: DataFrame, out: str, spot: Column, points: Column, vol: Column, linear: Column) -> DataFrame:
    """d with out_linear, out_irs, out_straddle one day on: a straddle whose life ends is struck anew."""
    rolls = F.col("tenor") <= 1.0 / S.TRADING_DAYS + 1e-12
    d = d.withColumns({"_spot": spot, "_r": rate(points), "_vol": vol / 100, f"{out}_linear": linear})
    d = d.withColumn("_k", F.when(rolls, F.col("_spot")).otherwise(F.col("strike")))
    d = d.withColumn("_t", F.when(rolls, F.lit(S.STRADDLE_DAYS / S.TRADING_DAYS)).otherwise(F.greatest(F.col("tenor") - 1.0 / S.TRADING_DAYS, F.lit(0.0))))
    d = d.withColumn(f"{out}_irs", irs_value(F.col("_r")))
    d = with_straddle(d, f"{out}_straddle", F.col("_spot"), F.col("_k"), F.col("_t"), F.col("_r"), F.col("_vol"))
    return d.withColumn(f"{out}_straddle", F.col(f"{out}_straddle") * S.STRADDLE_SHARES).drop("_spot", "_r", "_vol", "_k", "_t")


def snapshots(lv: DataFrame) -> DataFrame:
    """A row for each day that has a next one: levels, shares, state and values today; d, f: the next day and its ordinal; real_<component>:
    the value of today's book on the next day's levels."""
    d = values(lv)
    ahead = {f"n_{c}": F.lead(c).over(rows()) for c in (*S.ASSETS, "vol_idx", "rate_idx", "d")}
    d = d.withColumns(ahead).withColumn("f", F.col("i") + 1).where("n_d is not null")
    d = _horizon(d, "real", F.col(f"n_{S.UNDERLYING}"), F.col("n_rate_idx"), F.col("n_vol_idx"), linear_value({c: F.col(f"n_{c}") for c in S.ASSETS}))
    return d.withColumnRenamed("d", "snapshot_d").withColumnRenamed("n_d", "d").drop(*(c for c in ahead if c != "n_d"))


def scenarios(lv: DataFrame, window: int = S.WINDOW, first: int | None = None, shocks: DataFrame | None = None, extra=()) -> DataFrame:
    """A row for each (book, forecast f, shock ordinal): pnl_<component> of the scenario, with what the snapshot has. f starts at `first`
    (window + 1 by default). The levels are computed once."""
    lv = once(lv)
    snap = dealt(snapshots(lv).where(F.col("f") >= (first or window + 1)), S.BOOK, "f")
    days = snap.withColumn("shock_i", F.explode(F.sequence(F.col("f") - window, F.col("f") - 1)))
    shocks = hist_shocks(lv) if shocks is None else shocks
    if shocks.select("i").limit(SEND_ROWS + 1).count() <= SEND_ROWS:
        shocks = F.broadcast(shocks)
    s = shocks.select(F.col(S.BOOK), F.col("i").alias("shock_i"), F.col("d").alias("shock_d"), *SHOCKS, *extra)
    return price_scenarios(days.join(s, [S.BOOK, "shock_i"]))


def price_scenarios(d: DataFrame) -> DataFrame:
    moved = {c: F.col(c) * F.exp(F.col(f"s_{c[-1]}")) for c in S.ASSETS}
    d = _horizon(d, "v1", moved[S.UNDERLYING], F.col("rate_idx") + F.col("s_rate"), F.col("vol_idx") * F.exp("s_vol"), linear_value(moved))
    return d.withColumns({f"pnl_{c}": F.col(f"v1_{c}") - F.col(f"v_{c}") for c in S.COMPONENTS})


def loss() -> Column:
    return -(F.col("pnl_linear") + F.col("pnl_irs") + F.col("pnl_straddle"))


def value() -> Column:
    return F.col("v_linear") + F.col("v_irs") + F.col("v_straddle")


def realised() -> Column:
    return F.col("real_linear") + F.col("real_irs") + F.col("real_straddle") - value()


def estimate(scen: DataFrame, window: int, alpha: float = S.ALPHA, extra=()) -> DataFrame:
    """VaR and ES (not under 0), mean and standard deviation of losses, realised loss and exception of each forecast."""
    k = tail_count(window, alpha)
    s = scen.withColumns({"loss": loss(), "value": value(), "realised_pnl": realised()})
    keep = [F.first(c).alias(c) for c in ("d", "snapshot_d", "value", "realised_pnl")]
    g = s.groupBy(S.BOOK, "f").agg(F.collect_list("loss").alias("_l"), F.avg("loss").alias("mean_loss"), F.stddev_samp("loss").alias("vol_loss"), *keep, *extra)
    g = g.withColumns({c: F.greatest(v, F.lit(0.0)) for c, v in worst(F.col("_l"), k).items()}).drop("_l")
    g = g.withColumn("tail_scenarios", F.lit(k)).withColumn("realised_loss", -F.col("realised_pnl"))
    return g.withColumn("exception", (F.col("realised_pnl") < -F.col("var")).cast("int"))


def rolling(lv: DataFrame, window: int = S.WINDOW, alpha: float = S.ALPHA, first: int | None = None) -> DataFrame:
    return estimate(scenarios(lv, window, first), window, alpha)


def over_windows(lv: DataFrame, windows, alpha: float = S.ALPHA) -> DataFrame:
    """(window, book, f, d, pnl, var, es): rolling() of several windows. Each scenario is priced once, for the longest; the shorter take those of their own
    days. A forecast has the windows that it has enough days for."""
    s = scenarios(lv, max(windows), first=min(windows) + 1).withColumns({"loss": loss(), "pnl": realised()})
    own = [F.collect_list(F.when(F.col("shock_i") >= F.col("f") - w, F.col("loss"))).alias(f"_l{w}") for w in windows]
    g = s.groupBy(S.BOOK, "f").agg(F.first("d").alias("d"), F.first("pnl").alias("pnl"), *own)
    tails = {w: worst(F.col(f"_l{w}"), tail_count(w, alpha)) for w in windows}
    g = g.select(S.BOOK, "f", "d", "pnl", F.inline(F.array(*[F.struct(F.lit(w).alias("window"), *(F.when(F.col("f") > w, F.greatest(v, F.lit(0.0))).alias(c) for c, v in t.items())) for w, t in tails.items()])))
    return g.where(F.col("f") > F.col("window"))


def realised_parts(lv: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """(book, f, component, realised_loss) of the days that rolling() forecasts: of the snapshots alone, without a scenario."""
    parts = F.inline(F.array(*[F.struct(F.lit(c).alias("component"), (F.col(f"v_{c}") - F.col(f"real_{c}")).alias("realised_loss")) for c in S.COMPONENTS]))
    return snapshots(lv).where(F.col("f") > window).select(S.BOOK, "f", parts)


def vol_ratios(lv: DataFrame, vol_window: int = 60) -> DataFrame:
    """Shocks with vol_<shock>: rolling standard deviation, 0 as missing, filled forwards, then backwards."""
    d = hist_shocks(lv)
    ahead = rows().rowsBetween(0, Window.unboundedFollowing)
    back = rows().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"vol_{c}": F.when(F.col("i") >= vol_window, F.nullif(F.stddev_samp(c).over(frame(1 - vol_window, 0)), F.lit(0.0))) for c in SHOCKS})
    d = d.withColumns({f"vol_{c}": F.last(f"vol_{c}", ignorenulls=True).over(back) for c in SHOCKS})
    return d.withColumns({f"vol_{c}": F.first(f"vol_{c}", ignorenulls=True).over(ahead) for c in SHOCKS})


def vol_adjusted(lv: DataFrame, window: int = S.WINDOW, alpha: float = S.ALPHA, vol_window: int = 60) -> DataFrame:
    """Shocks scaled by the last day's volatility over their own; avg_vol_ratio is the mean over factors of the last over the window's mean."""
    lv = once(lv)
    vols = vol_ratios(lv, vol_window)
    names = [f"vol_{c}" for c in SHOCKS]
    snap = snapshots(lv).where(F.col("f") >= window + 1)
    now = vols.select(S.BOOK, (F.col("i") + 1).alias("f"), *(F.col(c).alias(f"now_{c}") for c in names))
    snap = dealt(snap.join(now, [S.BOOK, "f"]), S.BOOK, "f")
    days = snap.withColumn("shock_i", F.explode(F.sequence(F.col("f") - window, F.col("f") - 1)))
    s = vols.select(S.BOOK, F.col("i").alias("shock_i"), F.col("d").alias("shock_d"), *SHOCKS, *names)
    if s.select("shock_i").limit(SEND_ROWS + 1).count() <= SEND_ROWS:
        s = F.broadcast(s)
    d = days.join(s, [S.BOOK, "shock_i"])
    d = d.withColumns({c: F.col(c) * F.coalesce(F.col(f"now_vol_{c}") / F.nullif(F.col(f"vol_{c}"), F.lit(0.0)), F.lit(1.0)) for c in SHOCKS})
    ratio = sum(F.first(f"now_{c}") / F.avg(c) for c in names) / len(names)
    return estimate(price_scenarios(d), window, alpha, extra=[ratio.alias("avg_vol_ratio")])


def components(lv: DataFrame, window: int = S.WINDOW, alpha: float = S.ALPHA) -> DataFrame:
    """Each component's own VaR, ES, realised P&L and exception: (book, f, d, component, ...)."""
    k = tail_count(window, alpha)
    s = scenarios(lv, window)
    aggs = [F.collect_list(-F.col(f"pnl_{c}")).alias(f"_l_{c}") for c in S.COMPONENTS]
    aggs += [F.first(F.col(f"real_{c}") - F.col(f"v_{c}")).alias(f"_r_{c}") for c in S.COMPONENTS]
    g = s.groupBy(S.BOOK, "f").agg(F.first("d").alias("d"), F.first("snapshot_d").alias("snapshot_d"), *aggs)
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"_l_{c}").alias("_l"), F.col(f"_r_{c}").alias("realised_pnl")) for c in S.COMPONENTS]))
    g = g.select(S.BOOK, "f", "d", "snapshot_d", rows)
    g = g.withColumns({c: F.greatest(v, F.lit(0.0)) for c, v in worst(F.col("_l"), k).items()}).drop("_l")
    return g.withColumns({"realised_loss": -F.col("realised_pnl"), "exception": (F.col("realised_pnl") < -F.col("var")).cast("int"), "tail_scenarios": F.lit(k)})


def tail_usage(lv: DataFrame, window: int = S.WINDOW, alpha: float = S.ALPHA) -> DataFrame:
    """The scenarios in each forecast's tail: (book, f, d, shock_d, tail_rank, scenario_loss, realised_loss)."""
    k = tail_count(window, alpha)
    s = scenarios(lv, window).withColumn("loss", loss())
    top = F.slice(F.sort_array(F.collect_list(F.struct("loss", "shock_i", "shock_d")), asc=False), 1, k)
    g = s.groupBy(S.BOOK, "f").agg(F.first("d").alias("d"), F.first(-realised()).alias("realised_loss"), top.alias("t"))
    g = g.select(S.BOOK, "f", "d", "realised_loss", F.posexplode("t").alias("pos", "s"))
    return g.select(S.BOOK, "f", "d", F.col("s.shock_d").alias("shock_d"), (F.col("pos") + 1).cast("long").alias("tail_rank"), F.col("s.loss").alias("scenario_loss"), "realised_loss")
