"""Summaries of results: stress windows, tails, extreme days, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import backtest
from .panel import frame


def stress_dim(like: DataFrame, windows=S.STRESS) -> DataFrame:
    spark = like.sparkSession
    return spark.createDataFrame(list(windows), "label string, first string, last string").select("label", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


def in_windows(df: DataFrame, windows=S.STRESS, others: str | None = "outside") -> DataFrame:
    """A row for each window that holds a day (both ends count), one labelled `full`, and one labelled `outside` for days of no window. The
    windows are a handful of constants, so labels are an array of literals and no join."""
    hit = [F.when(F.col("d").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(label)) for label, a, b in windows]
    labels = F.array_compact(F.array(*hit))
    if others:
        labels = F.when(F.size(labels) == 0, F.array(F.lit(others))).otherwise(labels)
    return df.withColumn("label", F.explode(F.concat(F.array(F.lit("full")), labels)))


def summarize(df: DataFrame, by=("label",), confidence: float = S.ALPHA, extra=()) -> DataFrame:
    """Tests, severity and mean VaR and ES of each group of rows (by, d, pnl, var, es), and `extra` aggregates."""
    more = [F.min("d").alias("first_d"), F.max("d").alias("last_d"), backtest.severity().alias("severity"), F.avg("var").alias("mean_var"), F.avg("es").alias("mean_es"), F.max("var").alias("max_var"), F.max("es").alias("max_es")]
    return backtest.run(df.withColumn("exception", (F.col("pnl") < -F.col("var")).cast("int")), by, confidence, more=[*more, *extra])


def crisis_table(df: DataFrame, by=("method",), windows=S.STRESS, confidence: float = S.ALPHA, fewest: int = 50) -> DataFrame:
    """A row for each group and period (full, each window, and outside of all): counts, losses, mean and greatest VaR and ES, and the tests where
    there are `fewest` days. note tells where they are left out or only describe; a period without days has t = 0 and nulls."""
    c, loss = F.col, -F.col("pnl")
    hit = lambda f: f(F.when(c("exception") == 1, loss))
    extra = [F.max(loss).alias("max_loss"), F.avg(loss).alias("mean_loss"), hit(F.avg).alias("mean_exception_loss"), hit(F.max).alias("max_exception_loss")]
    d = summarize(in_windows(df, windows), (*by, "label"), confidence, extra)
    names = F.array(*[F.lit(x) for x in ("full", *(w[0] for w in windows), "outside")])
    d = df.select(*by).distinct().withColumn("label", F.explode(names)).join(d, [*by, "label"], "left").fillna(0, ["t", "n"])
    enough = c("t") >= fewest
    short = F.when(c("t") == 0, F.lit("no days")).when(~enough, F.lit(f"under {fewest} days: descriptive"))
    apart = F.when((c("label") == "outside") & (c("t") > 0), F.lit("not contiguous: p_cc is descriptive"))
    return d.select(
        *by, "label", "first_d", "last_d", "t", "n", (c("t") * (1 - confidence)).alias("expected_n"), "rate", "mean_var", "mean_es", "max_var", "max_es", "mean_loss", "max_loss",
        "mean_exception_loss", "max_exception_loss", F.when(enough, c("p_uc")).alias("p_uc"), F.when(enough, c("p_cc")).alias("p_cc"), F.concat_ws("; ", short, apart).alias("note"),
    )


def tail_summary(usage: DataFrame, n: int = 15) -> DataFrame:
    """The n shock days most often in a tail."""
    g = usage.groupBy("shock_d").agg(
        F.count("*").alias("times_in_tail"),
        F.sum((F.col("tail_rank") == 1).cast("long")).alias("times_worst"),
        F.avg("tail_rank").alias("mean_rank"),
        F.max("scenario_loss").alias("max_loss"),
        F.avg("scenario_loss").alias("mean_loss"),
        F.avg("realised_loss").alias("mean_realised"),
    )
    return g.orderBy(F.desc("times_in_tail"), F.desc("times_worst"), F.desc("max_loss")).limit(n)


def extreme_days(results: DataFrame, components: DataFrame, n: int = 15) -> DataFrame:
    """The n days of greatest realised loss, their components' losses in columns, and the one that drove it (the first of equals)."""
    wide = components.groupBy(S.BOOK, "f").pivot("component", list(S.COMPONENTS)).agg(F.first("realised_loss"))
    top = results.orderBy(F.desc("realised_loss"), "d").limit(n).join(wide, [S.BOOK, "f"], "left")
    most = F.greatest(*S.COMPONENTS)
    driver = F.when(F.col("linear") >= most, "linear").when(F.col("irs") >= most, "irs").otherwise("straddle")
    return top.withColumn("driver", driver)


def stability(df: DataFrame, columns, order: str = "d") -> DataFrame:
    """Mean, standard deviation, least, greatest and greatest change of each column, one row each."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("value")) for c in columns]))
    d = df.select(order, rows)
    d = d.withColumn("change", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("parameter").orderBy(order))))
    return d.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.max("change").alias("max_change"))


def stability_with_counts(df: DataFrame, columns, counts: dict[str, Column], clean: Column | None = None, order: str = "d") -> DataFrame:
    """stability() of the clean rows (all, if no condition is given), for columns with two values or more, and a row _meta_<name> for each count: the number of
    rows, of all, that a condition holds for, as the mean. A null condition doesn't hold. Without a clean row there is no table."""
    clean = F.coalesce(clean, F.lit(False)) if clean is not None else F.lit(True)
    kept = df.where(clean)
    two = kept.agg(*(F.count(c).alias(c) for c in columns)).select(F.inline(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).alias("_n")) for c in columns])))
    table = stability(kept, columns, order).join(two.where("_n >= 2").drop("_n"), "parameter")
    n = df.agg(F.max(clean).alias("_any"), *(F.count_if(c).alias(k) for k, c in counts.items())).where("_any")
    n = n.select(F.inline(F.array(*[F.struct(F.lit(f"_meta_{k}").alias("parameter"), F.col(k).cast("double").alias("mean")) for k in counts])))
    return table.unionByName(n, allowMissingColumns=True)


def moments(value: Column) -> dict[str, Column]:
    """Mean, population standard deviation, skewness and excess kurtosis, and nine quantiles."""
    q = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
    return {"mean": F.avg(value), "std": F.stddev_pop(value), "skew": F.skewness(value), "kurt": F.kurtosis(value)} | {f"q{i}": F.percentile(value, x) for i, x in enumerate(q)}


def static_var(df: DataFrame, value: str, levels: dict[float, float]) -> DataFrame:
    """(book, confidence, var, es, var_normal) of a P&L column over all history, levels being confidences and their normal quantiles: the sample's
    quantile, the mean of what is at or beyond it, and a normal law of the sample's mean and deviation."""
    q = df.groupBy(S.BOOK).agg(F.percentile(value, [1 - a for a in levels]).alias("_q"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("confidence"), (-F.col("_q")[k]).alias("var"), (F.lit(z) * F.col("_s") - F.col("_m")).alias("var_normal")) for k, (a, z) in enumerate(levels.items())]))
    d = df.select(S.BOOK, F.col(value).alias("_v")).join(q.select(S.BOOK, rows), S.BOOK)
    return d.groupBy(S.BOOK, "confidence").agg(F.first("var").alias("var"), (-F.avg(F.when(F.col("_v") <= -F.col("var"), F.col("_v")))).alias("es"), F.first("var_normal").alias("var_normal"))


def rolling_moments(df: DataFrame, value: str, days: int = 30, around: int = 60) -> DataFrame:
    """(book, d, i, vol, mean, sd): the yearly volatility of the `days` rows up to a day; mean and deviation (from the whole sample's mean) of the
    `around` rows about it, half of them and one less before. Null where there are fewer."""
    back, about = frame(1 - days, 0), frame(1 - around // 2, around // 2)
    d = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(S.BOOK)))
    full = lambda w, n, x: F.when(F.count("*").over(w) == n, x.over(w))
    return d.select(
        S.BOOK, "d", "i",
        (full(back, days, F.stddev_samp(value)) * F.sqrt(F.lit(float(S.TRADING_DAYS)))).alias("vol"),
        full(about, around, F.avg(value)).alias("mean"),
        F.sqrt(full(about, around, F.avg(F.col("_c") * F.col("_c")))).alias("sd"),
    )


def summary_stats(value: str) -> dict[str, Column]:
    """n, mean, standard deviation, extremes, skewness, excess kurtosis, and whether the tails are fatter than normal ones."""
    v = F.col(value)
    return {
        "n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "least": F.min(v), "most": F.max(v), "skew": F.skewness(v), "kurt": F.kurtosis(v), "fat_tailed": F.kurtosis(v) > 1,
    }
