"""Panels: filled levels with ordinals, as-of joins, and the views of returns and shocks. Windows run within a book, so one shuffle by book
serves all that follows, and books are dealt over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

def rows():
    return Window.partitionBy(S.BOOK).orderBy("i")


def frame(first: int, last: int):
    """Rows i + first to i + last of the book."""
    return rows().rowsBetween(first, last)


def ffill(df: DataFrame, columns, limit: int | None = None, by: str = S.BOOK) -> DataFrame:
    """The last value of up to `limit` rows before (all, if None) for nulls."""
    w = Window.partitionBy(by).orderBy("d").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def levels(raw: DataFrame, limit: int = 3) -> DataFrame:
    """Filled rows without nulls, with their ordinal i from 0 in the book."""
    d = ffill(raw, S.ASSETS, limit).dropna(subset=[*S.ASSETS, "vol_idx", "rate_idx"])
    return d.withColumn("i", (F.row_number().over(Window.partitionBy(S.BOOK).orderBy("d")) - 1).cast("long"))


def as_of(left: DataFrame, right: DataFrame, columns, by: str = S.BOOK) -> DataFrame:
    """left with the columns of right's last row of the same book up to left's day. A union and a running last, so no pairs are made."""
    both = left.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in columns}).withColumn("_left", F.lit(1))
    other = right.select(by, "d", *columns, F.lit(0).alias("_left"))
    w = Window.partitionBy(by).orderBy("d", "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other, allowMissingColumns=True).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).where("_left = 1").drop("_left")


def before(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(rows())


def log_return(c: str) -> Column:
    return F.log(F.col(c) / before(c))


def log_returns(lv: DataFrame) -> DataFrame:
    r = {f"r_{c[-1]}": log_return(c) for c in S.ASSETS}
    return lv.select(S.BOOK, "d", "i", *(v.alias(k) for k, v in r.items())).where("i > 0")


def portfolio_return(lv: DataFrame) -> DataFrame:
    """x: the equal-weight log return."""
    r = log_returns(lv)
    return r.withColumn("x", sum(S.WEIGHT * F.col(f"r_{c[-1]}") for c in S.ASSETS))


def hist_shocks(lv: DataFrame) -> DataFrame:
    """Log returns of prices and volatility index; the rate's change in percentage points."""
    cols = [*(log_return(c).alias(f"s_{c[-1]}") for c in S.ASSETS), log_return("vol_idx").alias("s_vol"), (F.col("rate_idx") - before("rate_idx")).alias("s_rate")]
    return lv.select(S.BOOK, "d", "i", *cols).where("i > 0")


SHOCKS = (*(f"s_{c[-1]}" for c in S.ASSETS), "s_vol", "s_rate")


def mc_shocks(lv: DataFrame) -> DataFrame:
    """As hist_shocks, the rate's change as a fraction."""
    return hist_shocks(lv).withColumn("s_rate", F.col("s_rate") / 100)


def risk_factors(lv: DataFrame) -> DataFrame:
    """Log returns of three prices, level change of the underlying, changes of rate (points) and volatility index (points)."""
    change = lambda c: F.col(c) - before(c)
    cols = [log_return("px_d").alias("d_log"), change("rate_idx").alias("rate_chg"), log_return("px_b").alias("b_log"), log_return("px_a").alias("a_log"), change("px_d").alias("d_level_chg"), change("vol_idx").alias("vol_chg")]
    return lv.select(S.BOOK, "d", "i", *cols).where("i > 0")


def price_index(lv: DataFrame) -> DataFrame:
    """Prices as percent of the first."""
    return lv.select(S.BOOK, "d", "i", *((100 * F.col(c) / F.first(c).over(rows())).alias(f"idx_{c[-1]}") for c in S.ASSETS))


def date_set(a: DataFrame, b: DataFrame, how: str = "intersect") -> DataFrame:
    """Days of both panels, or of a alone (how: intersect, except)."""
    x, y = a.select(S.BOOK, "d"), b.select(S.BOOK, "d")
    return x.intersect(y) if how == "intersect" else x.exceptAll(y)


def violations(df: DataFrame, keys=(S.BOOK, "d")) -> DataFrame:
    """Keys that come twice, and rows with a null or NaN in a double column."""
    doubles = [c for c, k in df.dtypes if k == "double"]
    twice = df.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("problem"))
    gaps = df.where(F.greatest(*[(F.col(c).isNull() | F.isnan(c)).cast("int") for c in doubles], F.lit(0)) > 0).select(*keys, F.lit("not finite").alias("problem"))
    return twice.unionByName(gaps)
