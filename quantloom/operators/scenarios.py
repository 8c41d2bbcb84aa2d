"""One table of simulated scenarios, a row for each day and draw, of which every figure of a simulation is an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .monte_carlo import Model, reprice_parts
from .once import dealt, fresh_path

SCHEMA = "book string, d date, i long, draw int, " + ", ".join(f"pnl_{c} double" for c in S.COMPONENTS)


def table(model: Model, path: str | None = None) -> DataFrame:
    """(book, d, i, draw, pnl_<component>, pnl_total, year) of every scenario, written as Parquet by book and year, each day's rows together, and read back.

    Days are simulated where they are dealt, and go to files from there: no shuffle of scenarios. A reader of one day prunes by book and year, and by i within files.
    """
    draw = model.draw

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                x = reprice_parts(row, draw(row))
                yield pd.DataFrame({"book": row.book, "d": row.d, "i": row.i, "draw": np.arange(len(x), dtype=np.int32)} | {f"pnl_{c}": x[:, k] for k, c in enumerate(S.COMPONENTS)})

    spark = model.rows.sparkSession
    path = path or fresh_path(spark, "scenarios")
    rows = dealt(model.rows, S.BOOK, "i").mapInPandas(run, SCHEMA)
    total = sum((F.col(f"pnl_{c}") for c in S.COMPONENTS[1:]), F.col(f"pnl_{S.COMPONENTS[0]}"))
    rows.withColumns({"pnl_total": total, "year": F.year("d")}).write.partitionBy("year", S.BOOK).parquet(path)
    names = [*(c.split()[0] for c in SCHEMA.split(", ")), "pnl_total", "year"]
    return spark.read.schema(SCHEMA + ", pnl_total double, year int").parquet(path).select(*names)


def figures(scenarios: DataFrame, levels=(0.95, 0.99)) -> DataFrame:
    """(book, d, i, draws, mean_pnl, std_pnl, var_<level>, es_<level>): ES is the mean loss of the scenarios at VaR or beyond."""
    day = (S.BOOK, "d", "i")
    names = [f"{100 * a:g}" for a in levels]
    q = F.percentile("pnl_total", [1 - a for a in levels])
    d = scenarios.groupBy(*day).agg(F.count("*").alias("draws"), F.avg("pnl_total").alias("mean_pnl"), F.stddev_pop("pnl_total").alias("std_pnl"), q.alias("_q"))
    d = d.select(*day, "draws", "mean_pnl", "std_pnl", *((-F.col("_q")[k]).alias(f"var_{n}") for k, n in enumerate(names)))
    beyond = [F.avg(F.when(F.col("pnl_total") <= -F.col(f"var_{n}"), -F.col("pnl_total"))).alias(f"es_{n}") for n in names]
    es = scenarios.select(*day, "pnl_total").join(d.select(*day, *(f"var_{n}" for n in names)), list(day)).groupBy(*day).agg(*beyond)
    return d.join(es, list(day))


def shares(scenarios: DataFrame, alpha: float = S.ALPHA) -> DataFrame:
    """(book, d, i, var, es, es_<component>, share_<component>): what each component loses on average in the scenarios at VaR or beyond; the parts add up to ES."""
    day = (S.BOOK, "d", "i")
    var = scenarios.groupBy(*day).agg((-F.percentile("pnl_total", 1 - alpha)).alias("var"))
    tail = scenarios.join(var, list(day)).where(F.col("pnl_total") <= -F.col("var"))
    d = tail.groupBy(*day, "var").agg((-F.avg("pnl_total")).alias("es"), *((-F.avg(f"pnl_{c}")).alias(f"es_{c}") for c in S.COMPONENTS))
    return d.withColumns({f"share_{c}": F.col(f"es_{c}") / F.col("es") for c in S.COMPONENTS})


def static(scenarios: DataFrame, levels: dict[float, float]) -> DataFrame:
    """(book, confidence, var, es, var_normal) over all scenarios of a book; levels: confidence to normal quantile."""
    q = F.percentile("pnl_total", [1 - a for a in levels])
    d = scenarios.groupBy(S.BOOK).agg(F.avg("pnl_total").alias("_m"), F.stddev_samp("pnl_total").alias("_s"), q.alias("_q"))
    rows = F.array(*[F.struct(F.lit(a).alias("confidence"), (-F.col("_q")[k]).alias("var"), (z * F.col("_s") - F.col("_m")).alias("var_normal")) for k, (a, z) in enumerate(levels.items())])
    d = d.select(S.BOOK, F.inline(rows))
    es = scenarios.select(S.BOOK, "pnl_total").join(F.broadcast(d.select(S.BOOK, "confidence", "var")) if d.count() <= 10_000 else d, S.BOOK)
    es = es.where(F.col("pnl_total") <= -F.col("var")).groupBy(S.BOOK, "confidence").agg((-F.avg("pnl_total")).alias("es"))
    return d.join(es, [S.BOOK, "confidence"]).select(S.BOOK, "confidence", "var", "es", "var_normal")


def day_slice(scenarios: DataFrame, day: str, worst: int = 10) -> DataFrame:
    """(book, d, rank, draw, pnl_<component>, pnl_total, at): one day's `worst` scenarios; `at` is the share of the day's that are as bad or worse. Only that day's
    year is read."""
    own = scenarios.where((F.col("year") == F.year(F.lit(day).cast("date"))) & (F.col("d") == F.lit(day).cast("date")))
    w = Window.partitionBy(S.BOOK).orderBy("pnl_total", "draw")
    d = own.withColumns({"rank": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(S.BOOK))}).where(F.col("rank") <= worst)
    return d.select(S.BOOK, "d", "rank", "draw", *(f"pnl_{c}" for c in S.COMPONENTS), "pnl_total", (F.col("rank") / F.col("_n")).alias("at"))
