"""Sources and sinks: market panels from tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

PANEL = T.StructType([T.StructField("d", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in (*S.ASSETS, "vol_idx", "rate_idx"))])


def lineitem_panel(spark: SparkSession, sf_dir: str, books: str | None = None) -> DataFrame:
    """A row for each book and day of `lineitem`: four prices (null where nothing traded), a volatility index and a rate index in percent. One book,
    or one for each region of suppliers (books: region): books are spread over the cluster."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.lit("main")
    if books == "region":
        names = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
        suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
        d, key = d.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), F.col("r_name")
    price = lambda flag, status: F.avg(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), F.col("l_extendedprice")))
    return d.groupBy(key.alias(S.BOOK), F.col("l_shipdate").cast("date").alias("d")).agg(
        price("A", "F").alias("px_a"),
        price("A", "O").alias("px_b"),
        price("N", "F").alias("px_c"),
        price("N", "O").alias("px_d"),
        F.avg("l_quantity").alias("vol_idx"),
        (100 * F.avg("l_discount")).alias("rate_idx"),
    )


def orders_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second calendar: the mean order value of each day of `orders`, summed in cents, so that the order of rows doesn't show."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return d.groupBy(F.lit("main").alias(S.BOOK), F.col("o_orderdate").cast("date").alias("d")).agg((F.sum(F.round(100 * F.col("o_totalprice")).cast("long")) / (100.0 * F.count("o_totalprice"))).alias("order_idx"))


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", book: str = "main") -> DataFrame:
    """A panel from parquet or CSV files with a header (schema PANEL; a column named `book` in parquet is kept)."""
    if fmt == "csv":
        return spark.read.schema(PANEL).csv(path, header=True).withColumn(S.BOOK, F.lit(book))
    df = spark.read.format(fmt).load(path)
    return df if S.BOOK in df.columns else df.withColumn(S.BOOK, F.lit(book))


def complete_cases(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the result at path; CSV gets a header."""
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if fmt == "csv" else w.format(fmt).save(path)


#: Fixed names of a date column, the likeliest first, and the form of a date in any other.
DATE_NAMES, DATE_FORM = ("Date", "date", "X", "_c0"), r"^\d{4}-\d{2}-\d{2}$"


def date_column(df: DataFrame) -> str:
    """The column of df that holds its dates: one of DATE_NAMES, else the first with a value whose values, apart from nulls and empty ones, all look like
    dates (one pass over df). ValueError where there is none."""
    for name in DATE_NAMES:
        if name in df.columns:
            return name
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    filled = [F.when(F.length(c) > 0, c.rlike(DATE_FORM)) for c in text]
    fits = df.agg(*(F.min(c).alias(f"_{k}") for k, c in enumerate(filled))).first()
    for name, fit in zip(df.columns, fits):
        if fit:
            return name
    raise ValueError(f"no column of dates among {df.columns}")


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of another program's estimates as (d, pnl, var, exception): its dates found by date_column, loss or P&L, VaR or VaR_95, and exceptions told or else
    found from these. Columns of the same names in another case are told apart."""
    df = spark.read.option("header", True).csv(path)
    have = set(df.columns)
    number = lambda c, sign=1: sign * F.col(f"`{c}`").cast("double")
    pick = lambda *ways: next((e for c, e in ways if c in have), F.lit(None).cast("double"))
    pnl = pick(("pnl", number("pnl")), ("realised_pnl", number("realised_pnl")), ("actual_loss", number("actual_loss", -1)))
    var = pick(("VaR", number("VaR")), ("var", number("var")), ("VaR_95", number("VaR_95")))
    d = df.select(F.to_date(F.col(f"`{date_column(df)}`").cast("string")).alias("d"), pnl.alias("pnl"), var.alias("var"), *(number(c).cast("int").alias(c) for c in ("exception", "exception_95") if c in have))
    told = [F.col(c) for c in ("exception", "exception_95") if c in have]
    return d.select("d", "pnl", "var", F.coalesce(*told, (F.col("pnl") < -F.col("var")).cast("int")).alias("exception"))


def methods(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(method, d, pnl, var) of those results of a registry that exist and have the columns."""
    out = None
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if {"d", "pnl", "var"} <= set(df.columns):
            df = df.select(F.lit(name).alias("method"), "d", "pnl", "var")
            out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "method string, d date, pnl double, var double")
