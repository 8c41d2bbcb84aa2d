"""Backtests as aggregates: coverage, independence and exact binomial tests, for any number of groups at once.

Input everywhere: rows of (group columns, d, pnl, var); a breach is pnl < -var.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.pricing import chi2_tail

EPS = 1e-10


def exceptions(pnl: DataFrame, var: DataFrame, keys=(S.BOOK, "d")) -> DataFrame:
    """pnl joined with var on common keys, with exception 0 or 1."""
    return pnl.join(var, list(keys)).withColumn("exception", (F.col("pnl") < -F.col("var")).cast("int"))


def _ln(p: Column) -> Column:
    return F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))


def counts(df: DataFrame, by, more=()) -> DataFrame:
    """t, n and the transitions n00, n01, n10, n11 of each group, in order of d; `more` aggregates come from the same pass."""
    w = Window.partitionBy(*by).orderBy("d")
    d = df.withColumn("_e", F.col("exception")).withColumn("_p", F.lag("exception").over(w))
    n = lambda a, b: F.coalesce(F.sum(((F.col("_p") == a) & (F.col("_e") == b)).cast("long")), F.lit(0)).alias(f"n{a}{b}")
    return d.groupBy(*by).agg(F.count("*").alias("t"), F.sum("_e").cast("long").alias("n"), n(0, 0), n(0, 1), n(1, 0), n(1, 1), *more)


def kupiec(t: Column, n: Column, p: float) -> Column:
    """LR of unconditional coverage, not under 0; logs of the observed rate are held off 0."""
    rest = t - n
    null = n * F.log(F.lit(p)) + rest * F.log(F.lit(1 - p))
    rate = n / t
    return F.greatest(-2 * (null - (n * _ln(rate) + rest * _ln(1 - rate))), F.lit(0.0))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(EPS))


def christoffersen(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """LR of independence, not under 0."""
    p01, p11 = _share(n01, n00 + n01), _share(n11, n10 + n11)
    p = _share(n01 + n11, n00 + n01 + n10 + n11)
    null = (n00 + n10) * _ln(1 - p) + (n01 + n11) * _ln(p)
    free = n00 * _ln(1 - p01) + n01 * _ln(p01) + n10 * _ln(1 - p11) + n11 * _ln(p11)
    return F.greatest(-2 * (null - free), F.lit(0.0))


def degenerate_as_null(df: DataFrame, p: float) -> DataFrame:
    """The other convention: statistics are null where a count makes them degenerate."""
    c = F.col
    safe = lambda x: F.when(x > 0, F.log(F.when(x > 0, x))).otherwise(F.lit(0.0))
    rate = c("n") / c("t")
    uc = F.when((c("n") > 0) & (c("n") < c("t")), -2 * (c("n") * F.log(p / rate) + (c("t") - c("n")) * F.log((1 - p) / (1 - rate))))
    a, b = c("n00") + c("n01"), c("n10") + c("n11")
    p01, p11, q = c("n01") / a, c("n11") / b, (c("n01") + c("n11")) / (a + b)
    floor = lambda x: F.log(F.when(x > 0, x).otherwise(F.lit(EPS)))
    ind = -2 * ((c("n00") + c("n10")) * safe(1 - q) + (c("n01") + c("n11")) * safe(q) - c("n00") * safe(1 - p01) - c("n01") * floor(p01) - c("n10") * safe(1 - p11) - c("n11") * floor(p11))
    return df.withColumns({"lr_uc_strict": uc, "lr_ind_strict": F.when((a > 0) & (b > 0), ind)})


def binomial(df: DataFrame, p: float, level: float = 0.05) -> DataFrame:
    """df (t, n) with the inclusive acceptance range of n and its two-sided exact p-value: folds over 0 .. t within a row, so that a group is
    one row whatever its length."""
    t, n = F.col("t"), F.col("n")
    ks = F.sequence(F.lit(0).cast("long"), t)
    none = F.lit(None).cast("long")

    def ahead(acc, k):  # ln C(t, k) grows by ln((t - k + 1) / k)
        return F.when(k > 0, acc["c"] + F.log((t - k + 1) / k)).otherwise(F.lit(0.0))

    def pmf(c, k):
        return F.exp(c + k * F.log(F.lit(p)) + (t - k) * F.log(F.lit(1 - p)))

    def step(acc, k):
        own = pmf(ahead(acc, k), k)
        cdf = acc["cdf"] + own
        return F.struct(
            ahead(acc, k).alias("c"), cdf.alias("cdf"),
            F.coalesce(acc["lower"], F.when(cdf >= level / 2, k)).alias("lower"), F.coalesce(acc["upper"], F.when(cdf >= 1 - level / 2, k)).alias("upper"),
            F.when(k == n, own).otherwise(acc["own"]).alias("own"),
        )

    def total(acc, k):
        own = pmf(ahead(acc, k), k)
        return F.struct(ahead(acc, k).alias("c"), (acc["sum"] + F.when(own <= F.col("_b.own") * (1 + 1e-7), own).otherwise(F.lit(0.0))).alias("sum"))

    zero = F.lit(0.0)
    first = F.struct(zero.alias("c"), zero.alias("cdf"), none.alias("lower"), none.alias("upper"), F.lit(None).cast("double").alias("own"))
    df = df.withColumn("_b", F.aggregate(ks, first, step))
    value = F.least(F.lit(1.0), F.aggregate(ks, F.struct(zero.alias("c"), zero.alias("sum")), total)["sum"])
    return df.withColumns({"lower": F.col("_b.lower"), "upper": F.col("_b.upper"), "binomial_p": value}).drop("_b")


def run(df: DataFrame, by=(S.BOOK,), confidence: float = S.ALPHA, level: float = 0.05, more=()) -> DataFrame:
    """All tests of each group of rows (by, d, pnl, var), with `more` aggregates of them: one pass over df."""
    p = 1 - confidence
    by = list(by)
    d = df if "exception" in df.columns else df.withColumn("exception", (F.col("pnl") < -F.col("var")).cast("int"))
    c = counts(d, by, more)
    c = c.withColumns({"lr_uc": kupiec(F.col("t"), F.col("n"), p), "lr_ind": christoffersen(*(F.col(x) for x in ("n00", "n01", "n10", "n11")))})
    c = c.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    c = c.withColumns({"p_uc": chi2_tail(F.col("lr_uc"), 1), "p_ind": chi2_tail(F.col("lr_ind"), 1), "p_cc": chi2_tail(F.col("lr_cc"), 2)})
    c = c.withColumns({"expected_n": F.round(F.col("t") * p, 1), "rate": F.col("n") / F.col("t"), **{f"reject_{x}": F.col(f"p_{x}") < level for x in ("uc", "ind", "cc")}})
    c = binomial(c, p, level)
    return c.withColumn("binomial_reject", (F.col("n") < F.col("lower")) | (F.col("n") > F.col("upper")))


def compare(results: DataFrame, by=("method",)) -> DataFrame:
    """run()'s rows as text for a table."""
    f = lambda fmt, c: F.format_string(fmt, F.col(c))
    return results.select(
        *by, F.col("t"), F.col("n"), f("%.1f", "expected_n").alias("expected"), F.format_string("%.2f%%", 100 * F.col("rate")).alias("rate"),
        format_p(F.col("p_uc")).alias("p_uc"), format_p(F.col("p_ind")).alias("p_ind"), format_p(F.col("p_cc")).alias("p_cc"),
        F.concat(F.lit("["), F.col("lower"), F.lit(", "), F.col("upper"), F.lit("]")).alias("accepted"),
    )


def format_p(p: Column) -> Column:
    return F.when(p < 1e-4, F.lit("< 0.0001")).otherwise(F.format_string("%.4f", p))


def by_year(df: DataFrame) -> DataFrame:
    """Days, exceptions and their rate by year and over all (year null)."""
    return df.withColumn("year", F.year("d")).rollup("year").agg(F.count("*").alias("observations"), F.sum("exception").cast("long").alias("exceptions"), F.avg("exception").alias("rate"))


def cumulative(df: DataFrame, p: float = 1 - S.ALPHA) -> DataFrame:
    w = Window.partitionBy(S.BOOK).orderBy("d")
    return df.select(S.BOOK, "d", "exception", F.sum("exception").over(w).alias("observed"), (p * F.count("*").over(w)).alias("expected"))


def severity() -> Column:
    """The mean of loss over VaR on days of exceptions; null without any."""
    return F.avg(F.when(F.col("exception") == 1, -F.col("pnl") - F.col("var")))
