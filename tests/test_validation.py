"""The second P&L, counts of stability, and estimates of other programs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import analysis, validation
from quantloom.plans import queries as Q
from quantloom.sources import market


@pytest.fixture(scope="module")
def twice(spark, sf):
    return validation.pnl_twice(Q.levels(spark, sf)).cache()


def test_two_implementations_agree_every_day(twice):
    rows = {r.part: r for r in validation.summary(twice).collect()}
    assert set(rows) == set(validation.PARTS)
    assert all(r.passed for r in rows.values()), rows
    assert len({r.days for r in rows.values()}) == 1


def test_a_wrong_price_fails(twice):
    wrong = twice.withColumn("abs_err", F.when(F.col("part") == "irs", 1.0).otherwise(F.col("abs_err")))
    assert not {r.part: r.passed for r in validation.summary(wrong).collect()}["irs"]
    missing = twice.withColumn("abs_err", F.when(F.col("part") != "linear", F.col("abs_err")))
    assert not {r.part: r.passed for r in validation.summary(missing).collect()}["linear"]
    assert validation.worst(twice, 3).count() == 3


def test_no_levels_no_rows(spark, sf):
    none = Q.levels(spark, sf).where("false")
    assert validation.pnl_twice(none).count() == 0 and validation.summary(validation.pnl_twice(none)).count() == 0


def test_stability_with_counts(spark):
    rows = [(1, 1.0, None, True), (2, 4.0, None, True), (3, 9.0, 1.0, False), (4, 2.0, 5.0, True), (5, 3.0, None, None)]
    d = spark.createDataFrame(rows, "d int, x double, y double, ok boolean")
    got = {r.parameter: r for r in analysis.stability_with_counts(d, ("x", "y"), {"n_ok": F.col("ok"), "n": F.lit(True)}, F.col("ok")).collect()}
    assert set(got) == {"x", "_meta_n_ok", "_meta_n"}  # y has one clean value
    assert (got["x"].least, got["x"].most, got["x"].max_change) == (1.0, 4.0, 3.0)
    assert got["_meta_n_ok"].mean == 3 and got["_meta_n"].mean == 5 and got["_meta_n"].std is None
    assert analysis.stability_with_counts(d.where("false"), ("x",), {"n": F.lit(True)}).count() == 0


def test_date_columns_are_found(spark):
    rows = [("a", "2020-01-02", "2020-01-02", 1.0), ("b", "", "2020-1-3", 2.0), ("c", None, "2020-01-04", 3.0)]
    d = spark.createDataFrame(rows, "note string, `when.day` string, other string, v double")
    assert market.date_column(d) == "when.day"
    assert market.date_column(d.withColumnRenamed("v", "Date")) == "Date"  # a name goes first
    with pytest.raises(ValueError):
        market.date_column(d.select("note", "v"))
    with pytest.raises(ValueError):
        market.date_column(d.select("`when.day`").where("false"))


def test_estimates_of_other_programs(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",actual_loss,VaR_95,exception_95\n2020-01-02,3.5,2,1\n2020-01-03,-1,2,0\n")
    (tmp_path / "b.csv").write_text("id,realised_pnl,var\n2020-01-02,-3.5,2\n2020-01-03,1,\n")
    a = market.read_estimates(spark, f"file://{tmp_path}/a.csv").orderBy("d").collect()
    assert [tuple(r) for r in a] == [(dt.date(2020, 1, 2), -3.5, 2.0, 1), (dt.date(2020, 1, 3), 1.0, 2.0, 0)]
    b = market.read_estimates(spark, f"file://{tmp_path}/b.csv").orderBy("d").collect()
    assert [tuple(r) for r in b] == [(dt.date(2020, 1, 2), -3.5, 2.0, 1), (dt.date(2020, 1, 3), 1.0, None, None)]
