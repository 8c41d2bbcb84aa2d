"""Extreme-value VaR: peaks over threshold on rolling windows of losses or residuals. A window is an array column; each is fitted on its own,
so windows are dealt over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from .once import dealt
from .panel import frame

POT_SCHEMA = "var double, var_raw double, var_mle double, xi double, xi_raw double, clamped boolean, sigma double, n_u int, f_u double, u double, ks_p double, fallback string, es double, es_raw double, es_mle double, es_fallback string"


def windows(df: DataFrame, value: str, window: int, first: int | None = None) -> DataFrame:
    """df with w, the `window` values before, where there are so many (and i >= first)."""
    d = df.withColumn("w", F.collect_list(value).over(frame(-window, -1))).where(F.size("w") == window)
    return d if first is None else d.where(F.col("i") >= first)


def fit(df: DataFrame, q: float | str = 0.9, alpha: float = S.ALPHA, floor: bool = True) -> DataFrame:
    """df with a column w of arrays -> its other columns and POT_SCHEMA. q: the threshold's quantile, or the name of a column of them."""
    keys = [c for c in df.columns if c != "w"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [K.pot(np.asarray(w, float), x, alpha, floor=floor) for w, x in zip(b["w"], b[q] if isinstance(q, str) else [q] * len(b))]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=list(K.POT_FIELDS))], axis=1)

    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), POT_SCHEMA])
    return dealt(df, *[c for c in (S.BOOK, "i") if c in keys]).mapInPandas(run, schema)


def rolling(losses: DataFrame, window: int = S.WINDOW, q: float = 0.9, alpha: float = S.ALPHA, first: int | None = None) -> DataFrame:
    """losses: (book, d, i, loss)."""
    return fit(windows(losses, "loss", window, first).select(S.BOOK, "d", "i", "loss", "w"), q, alpha)


def grid(losses: DataFrame, qs, windows, first: int, alpha: float = S.ALPHA) -> DataFrame:
    """(book, d, i, loss, q, window, POT columns) for all thresholds and windows, from one pass over the losses, each day of i >= first."""
    d = losses.withColumns({f"_w{n}": F.collect_list("loss").over(frame(-n, -1)) for n in windows}).where(F.col("i") >= first)
    d = d.select(S.BOOK, "d", "i", "loss", F.inline(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"_w{n}").alias("w")) for n in windows])))
    return fit(d.where(F.size("w") == F.col("window")).withColumn("q", F.explode(F.array(*map(F.lit, qs)))), "q", alpha)


def invariants(df: DataFrame) -> DataFrame:
    """Rows that break what always holds: ES >= VaR >= 0, shape in [-0.5, 1], scale > 0, 0 < f_u < 1."""
    c = F.col
    bad = (c("es") < c("var") - 1e-9) | (c("var") < 0) | (c("xi") < -0.5) | (c("xi") > 1) | (c("sigma") <= 0) | (c("f_u") <= 0) | (c("f_u") >= 1)
    return df.where(F.coalesce(bad, F.lit(False)))
