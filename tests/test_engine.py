import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import schema as S
from quantloom.functions import kernels as K
from quantloom.functions import pricing
from quantloom.operators import analysis, backtest, book, diagnostics, garch, hist_sim, monte_carlo, panel, tails
from quantloom.plans import queries as Q


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def market(spark, n, px=(1.0, 10.0, 20.0, 100.0), vol=20.0, rate=3.0, change=lambda i, row: row):
    rows = [change(i, ["main", day(i), *px, vol, rate]) for i in range(n)]
    return panel.levels(spark.createDataFrame(rows, "book string, d date, px_a double, px_b double, px_c double, px_d double, vol_idx double, rate_idx double"))


def test_tail_count_is_exact_in_decimals():
    assert [hist_sim.tail_count(n, a) for n, a in ((500, 0.99), (10, 0.8), (250, 0.99), (1, 0.99))] == [5, 2, 3, 1]


def test_worst_takes_an_order_statistic(spark):
    d = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(1, 501)]).alias("l"))
    r = d.select(*(c.alias(k) for k, c in hist_sim.worst(F.col("l"), 5).items())).first()
    assert (r["var"], r.es) == (496.0, 498.0)


def test_swap_annuity_sums_discount_factors_at_rate_zero_too(spark):
    r = spark.createDataFrame([(0.04,), (0.0,)], "r double").select(pricing.annuity(F.col("r")).alias("a"), pricing.irs_value(F.col("r")).alias("v"), pricing.irs_dv01(F.col("r")).alias("p")).collect()
    a = sum(1.04**-k for k in range(1, 11))
    assert r[0].a == pytest.approx(a) and r[0].v == pytest.approx(1e6 * 0.01 * a) and r[0].p == pytest.approx(1e6 * a * 1e-4)
    assert r[1].a == pytest.approx(10)


def test_straddle_is_a_call_and_a_put_and_intrinsic_at_expiry(spark):
    d = spark.createDataFrame([(100.0, 90.0, 0.25, 0.03, 0.2), (100.0, 90.0, 0.0, 0.03, 0.2)], "s double, k double, t double, r double, v double")
    r = [x.p for x in pricing.with_straddle(d, "p", *(F.col(c) for c in "sktrv")).collect()]
    n = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    d1 = (math.log(100 / 90) + (0.03 + 0.02) * 0.25) / 0.1
    call = 100 * n(d1) - 90 * math.exp(-0.0075) * n(d1 - 0.1)
    assert r[0] == pytest.approx(2 * call - 100 + 90 * math.exp(-0.0075), abs=1e-10)
    assert r[1] == 10


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -3.0, -0.1, 0.0, 0.1, 2.0, 7.2, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(pricing.norm_cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-15)


def test_straddle_state_rolls_every_thirty_rows(spark):
    def rise(i, row):
        row[5] = 100.0 + i
        return row

    r = book.straddle_state(market(spark, 35, change=rise)).orderBy("i").collect()
    assert (r[29].rolled, r[29].days_held, r[29].strike) == (False, 29, 100.0)
    assert (r[30].rolled, r[30].days_held, r[30].strike, r[30].tenor) == (True, 0, 130.0, 30 / 252)
    assert r[29].tenor == 1 / 252


def test_forecasts_do_not_see_their_own_day(spark):
    def shock(i, row):
        row[2] = [1.0, 0.99, 0.9999, 0.5, 0.5, 0.5][i]
        return row

    r = hist_sim.rolling(market(spark, 6, change=shock), window=2, alpha=0.5).orderBy("f").collect()
    assert [x.f for x in r] == [3, 4, 5]
    assert r[0].d == day(3) and r[0].snapshot_d == day(2)
    assert r[0].exception == 1 and r[0]["var"] < 0.05 * 250_000
    assert r[1]["var"] > 0.4 * 125_000  # the shock is in the window the day after


def test_flat_market_then_a_crash_is_an_exception(spark):
    def crash(i, row):
        if i >= 501:
            row[5] = 80.0
        return row

    r = hist_sim.rolling(market(spark, 510, change=crash)).orderBy("f").collect()
    assert len(r) == 9 and r[0].tail_scenarios == 5 and r[0].exception == 1 and not any(x.exception for x in r[1:])


def test_components_sum_to_the_total(spark, sf):
    lv = Q.levels(spark, sf)
    c = hist_sim.components(lv).groupBy("f").agg(F.sum("realised_pnl").alias("s"))
    t = hist_sim.rolling(lv).join(c, "f")
    assert t.where(F.abs(F.col("s") - F.col("realised_pnl")) > 1e-6).count() == 0


def test_backtest_reproduces_known_values(spark):
    rows = [("a", day(i), -2.0 if i < 42 else 0.0, 1.0) for i in range(4269)]
    r = backtest.run(spark.createDataFrame(rows, "book string, d date, pnl double, var double")).first()
    assert (r.t, r.n, r.lower, r.upper) == (4269, 42, 30, 56)
    assert r.lr_uc == pytest.approx(0.011325716465819369, abs=1e-9)
    assert r.p_uc == pytest.approx(0.9152, abs=1e-4) and r.binomial_p == pytest.approx(1.0) and not r.binomial_reject
    assert r.reject_ind and r.n11 == 41


@pytest.mark.parametrize("n,reject", [(29, True), (30, False), (56, False), (57, True)])
def test_binomial_bounds_are_inclusive(spark, n, reject):
    d = spark.createDataFrame([("a", 4269, n)], "book string, t long, n long")
    r = backtest.binomial(d, 0.01).first()
    assert (n < r.lower or n > r.upper) == reject


def test_lecture_range(spark):
    r = backtest.binomial(spark.createDataFrame([("a", 500, 20)], "book string, t long, n long"), 0.05).first()
    assert (r.lower, r.upper) == (16, 35)


def test_severity_and_windows_with_both_ends(spark):
    d = spark.createDataFrame([("main", day(i), -p, v, 0.0) for i, (p, v) in enumerate([(8.0, 10.0), (12.0, 10.0), (16.0, 10.0)])], "book string, d date, pnl double, var double, es double")
    d = d.withColumn("exception", (F.col("pnl") < -F.col("var")).cast("int"))
    assert d.agg(backtest.severity().alias("s")).first().s == 4.0
    assert analysis.in_windows(d, (("w", "2020-01-02", "2020-01-03"),)).groupBy("label").count().orderBy("label").collect() == [("full", 3), ("outside", 1), ("w", 2)]


def test_as_of_takes_the_last_row_up_to_the_day(spark):
    left = spark.createDataFrame([("b", day(1)), ("b", day(3)), ("b", day(9)), ("c", day(5))], "book string, d date")
    right = spark.createDataFrame([("b", day(3), 1.0), ("b", day(5), 2.0)], "book string, d date, v double")
    assert [r.v for r in panel.as_of(left, right, ["v"]).orderBy("book", "d").collect()] == [None, 1.0, 2.0, None]


def test_ffill_stops_at_its_limit(spark):
    d = spark.createDataFrame([("b", day(i), v) for i, v in enumerate([1.0, None, None, None, None, 5.0])], "book string, d date, v double")
    assert [r.v for r in panel.ffill(d, ["v"], 3).orderBy("d").collect()] == [1.0, 1.0, 1.0, 1.0, None, 5.0]


def test_violations_are_found(spark):
    d = spark.createDataFrame([("b", day(0), 1.0), ("b", day(0), 2.0), ("b", day(1), None), ("b", day(2), float("nan"))], "book string, d date, v double")
    assert sorted(r.problem for r in panel.violations(d).collect()) == ["duplicate", "not finite", "not finite"]


def test_books_are_apart(spark):
    one = market(spark, 40)
    two = one.withColumn("book", F.lit("other")).withColumn("px_d", F.col("px_d") * (1 + F.col("i") / 100))
    both = book.pnl(one.unionByName(two))
    assert both.where("book = 'main'").exceptAll(book.pnl(one)).count() == 0
    assert both.count() == 78


def test_segments_fold_like_a_loop(spark):
    rng = np.random.default_rng(3)
    r = rng.standard_normal(30)
    d = spark.createDataFrame([("main", day(i), i, float(x)) for i, x in enumerate(r)], "book string, d date, i long, r double")
    fits = spark.createDataFrame([("main", k, 10 + 10 * k, 0.1, 0.05, 0.1, 0.85, 6.0, 0.0, 1.2, [1.0] * 10) for k in range(2)], garch.FIT_SCHEMA)
    got = {x.i: x.sigma for x in garch.volatility(d, fits, window=10, every=10).collect()}
    for start in (10, 20):
        s = 1.2
        for i in range(start, start + 10):
            assert got[i] == pytest.approx(math.sqrt(s))
            s = 0.05 + 0.1 * (r[i] - 0.1) ** 2 + 0.85 * s


def test_near_integrated_fits_take_the_last_valid_parameters(spark):
    rows = [("main", 0, 10, 0.1, 0.05, 0.1, 0.8, 6.0, 0.0, 1.0, [1.0]), ("main", 1, 20, 0.9, 0.9, 0.2, 0.7995, 6.0, 0.0, 1.0, [1.0])]
    r = garch.guarded(spark.createDataFrame(rows, garch.FIT_SCHEMA)).orderBy("refit").collect()
    assert r[1].reverted and (r[1].mu, r[1].beta) == (0.1, 0.8) and not r[0].reverted


def test_garch_evt_and_evt_estimates_hold_their_order(spark, sf):
    d = Q.garch_evt_var(Q.levels(spark, sf)).where("es < var - 1e-9 or var < 0")
    assert d.count() == 0


def test_monte_carlo_reruns_agree_and_are_near_historical_simulation(spark, sf):
    a = Q.queries()["mc_gaussian_var"](spark, sf).toPandas().sort_values("i")
    b = Q.queries()["mc_gaussian_var"](spark, sf).toPandas().sort_values("i")
    assert a["var"].tolist() == b["var"].tolist()
    hs = hist_sim.rolling(Q.levels(spark, sf)).agg(F.avg("var")).first()[0]
    assert 0.1 < a["var"].mean() / hs < 10


def test_pot_rows_name_their_fallbacks(spark):
    d = spark.createDataFrame([("main", 1, [float(x) for x in range(1, 61)])], "book string, i long, w array<double>")
    r = tails.fit(d, 0.9).first()
    assert r.fallback == "few_exceedances" and r.es >= r["var"] and r.n_u == 6


def test_result_files_round_trip(spark, sf, tmp_path):
    from quantloom.sources import market as M

    d = Q.levels(spark, sf).select("d", *S.ASSETS, "vol_idx", "rate_idx")
    for fmt in ("csv", "parquet"):
        M.write_result(d, str(tmp_path / fmt), fmt)
        assert M.read_panel(spark, str(tmp_path / fmt), fmt).count() == d.count()
    M.write_result(d.select("d", F.col("px_a").alias("pnl"), F.col("px_b").alias("var")), str(tmp_path / "m"))
    assert M.methods(spark, {"a": str(tmp_path / "m"), "gone": str(tmp_path / "none"), "other": str(tmp_path / "parquet")}).select("method").distinct().collect() == [("a",)]


def test_monte_carlo_queries_have_every_day(spark, sf):
    want = [r.i for r in monte_carlo.days(Q.levels(spark, sf)).select("i").orderBy("i").collect()]
    got = [r.i for r in Q.queries()["mc_gaussian_var"](spark, sf).select("i").orderBy("i").collect()]
    assert got == want == list(range(want[0], want[0] + len(want))) and len(want) > 100


def series(spark, n=400, seed=3):
    x = np.random.default_rng(seed).standard_t(6, n)
    return x, spark.createDataFrame([("main", i, float(v)) for i, v in enumerate(x)], "book string, i long, z double")


def ols(y, columns):
    m = np.column_stack([np.ones(len(y)), *columns])
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    rest = y - m @ b
    s2 = rest @ rest / (len(y) - m.shape[1])
    return b, b / np.sqrt(s2 * np.diag(np.linalg.inv(m.T @ m))), 1 - rest @ rest / ((y - y.mean()) ** 2).sum(), rest @ rest


def test_sign_bias_is_the_regression_it_stands_for(spark):
    z, d = series(spark)
    y, b = z[1:] ** 2, z[:-1]
    neg = (b < 0).astype(float)
    beta, t, _, rss = ols(y, [neg, neg * b, (1 - neg) * b])
    r = diagnostics.with_p(diagnostics.sign_bias_test(d, "z")).first()
    assert [r.c0, r.sign, r.neg_size, r.pos_size] == pytest.approx(beta) and [r.t_sign, r.t_neg, r.t_pos] == pytest.approx(t[1:])
    f = (((y - y.mean()) ** 2).sum() - rss) / 3 / (rss / (len(y) - 4))
    assert r.f == pytest.approx(f) and r.p_joint == pytest.approx(K.f_tail(f, 3, len(y) - 4)) and r.p_sign == pytest.approx(K.t_two_sided(t[1], len(y) - 4))


def test_arch_lm_and_unit_root_regressions(spark):
    z, d = series(spark)
    y = z * z
    _, _, r2, _ = ols(y[10:], [y[10 - k : -k] for k in range(1, 11)])
    r = diagnostics.arch_lm(d, "z").first()
    assert r.n == 390 and r.lm == pytest.approx(390 * r2, rel=1e-6) and r.p == pytest.approx(K.chi2_tail(390 * r2, 10), rel=1e-5)
    walk = spark.createDataFrame([("main", i, float(v)) for i, v in enumerate(np.cumsum(z))], "book string, i long, z double")
    r = diagnostics.dickey_fuller(d, "z").first()
    assert r.lags == 7 == int(399 ** (1 / 3)) and r.n == 392
    for x, table, root in ((z, d, False), (np.cumsum(z), walk, True)):
        dx, k = np.diff(x), 4
        at = np.arange(k, len(dx))
        _, t, _, _ = ols(dx[at], [x[at], at + 2.0, *(dx[at - j] for j in range(1, k + 1))])
        r = diagnostics.dickey_fuller(table, "z", lags=k).first()
        assert r.t == pytest.approx(t[1], rel=1e-6) and (r.p > 0.05) == root


def test_portmanteau_p_values(spark):
    z, d = series(spark)
    r = {x.series: x for x in diagnostics.portmanteau(d, {"z": F.col("z"), "z2": F.col("z") * F.col("z")}).collect()}
    for name, x in (("z", z), ("z2", z * z)):
        for m in (10, 20):
            q = K.ljung_box(x, m)
            assert r[name][f"q{m}"] == pytest.approx(q) and r[name][f"p{m}"] == pytest.approx(K.chi2_tail(q, m))


def test_grid_of_thresholds_is_each_of_them(spark, sf):
    losses = Q.portfolio_losses(Q.levels(spark, sf))
    last = losses.agg(F.max("i")).first()[0]
    d = tails.grid(losses, (0.85, 0.95), (250, 500), first=last - 3)
    for q in (0.85, 0.95):
        for w in (250, 500):
            one = {r.i: (r["var"], r.n_u) for r in tails.rolling(losses, w, q, first=last - 3).collect()}
            assert one and one == {r.i: (r["var"], r.n_u) for r in d.where((F.col("q") == q) & (F.col("window") == w)).collect()}


def test_fits_are_made_once(spark, sf):
    """One task of fits however often the rest reads them, and one of tails."""
    lv = Q.levels(spark, sf)
    plan = Q.garch_evt_var(lv)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1  # the tails; the fits are read
    assert Q.fhs_var(lv)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 0
    assert Q.evt_grid(lv)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_goodness_of_fit_keeps_nu(spark, sf):
    r = monte_carlo.copula_gof(Q.levels(spark, sf), replicates=10, draws=500, every=10**6).collect()
    assert len(r) == 1 and r[0].replicates == 10 and 0 <= r[0].p <= 1 and r[0].nu in range(2, 21)


def test_volatility_recursions_follow_their_formulas(spark):
    e = np.random.default_rng(4).standard_normal(30)
    d = spark.createDataFrame([([float(x) for x in e],)], "e array<double>")
    steps = {
        "garch": ((0.05, 0.1, 0.85, 0.0, 2.0), lambda s, x: math.sqrt(0.05 + 0.1 * x * x + 0.85 * s * s)),
        "gjr": ((0.05, 0.05, 0.85, 0.08, 2.0), lambda s, x: math.sqrt(0.05 + (0.13 if x < 0 else 0.05) * x * x + 0.85 * s * s)),
        "aparch": ((0.05, 0.08, 0.85, 0.3, 1.5), lambda s, x: (0.05 + 0.08 * (abs(x) - 0.3 * x) ** 1.5 + 0.85 * s**1.5) ** (1 / 1.5)),
    }
    for model, (p, step) in steps.items():
        s = 1.0
        for x in e:
            s = step(s, x)
        assert d.select(F.aggregate("e", F.lit(1.0), lambda a, b: garch.advance(model, a, b, *p))).first()[0] == pytest.approx(s)


def test_simulated_moves_are_priced_as_the_columns_are(spark, sf):
    from types import SimpleNamespace

    moves = book.factor_moves(Q.levels(spark, sf)).where("i between 40 and 60")
    want = {r.i: r.pnl_total for r in book.factor_pnl(moves).collect()}
    for r in moves.collect():
        got = monte_carlo.by_moves(SimpleNamespace(**r.asDict()), np.array([[r[c] for c in monte_carlo.MOVES]]))
        assert got[0] == pytest.approx(want[r.i], rel=1e-4, abs=5)


def test_factor_var_has_every_day_and_orders_its_levels(spark, sf):
    lv = Q.levels(spark, sf)
    kinds = dict(zip(monte_carlo.MOVES, ("garch", "gjr", "egarch", "aparch", "garch")))
    models = spark.createDataFrame([("main", m, kinds[m], "std", int(m == "d_log"), 0) for m in monte_carlo.MOVES], "book string, factor string, model string, law string, p int, q int")
    rows = monte_carlo.factor_var(lv, models, draws=300, every=1000).collect()
    n = lv.count()
    assert sorted(r.i for r in rows) == list(range(251, n)) and all(r.var_99 >= r.var_95 for r in rows)
    assert all(r.exception_99 == (-r.realised_pnl > r.var_99) for r in rows)


def test_crisis_table_gates_its_tests_and_names_empty_periods(spark):
    rows = [("m", dt.date(2001, 1, 1) + dt.timedelta(days=k), -3.0 if k % 20 == 0 else 1.0, 2.0, 2.5) for k in range(200)]
    d = spark.createDataFrame(rows, "method string, d date, pnl double, var double, es double")
    windows = (("short", "2001-01-01", "2001-01-30"), ("long", "2001-02-01", "2001-04-30"), ("none", "1990-01-01", "1990-12-31"))
    got = {r.label: r for r in analysis.crisis_table(d, windows=windows).collect()}
    assert set(got) == {"full", "short", "long", "none", "outside"}
    assert got["full"].t == 200 and got["full"].n == 10 and got["full"].p_uc is not None and got["full"].note == "" and got["full"].max_exception_loss == 3
    assert got["short"].t == 30 and got["short"].n == 2 and got["short"].p_uc is None and got["short"].note == "under 50 days: descriptive"
    assert got["long"].t == 89 and got["long"].p_cc is not None and got["long"].first_d == dt.date(2001, 2, 1)
    assert got["none"].t == 0 and got["none"].n == 0 and got["none"].mean_var is None and got["none"].note == "no days"
    assert got["outside"].t == 81 and got["outside"].note == "not contiguous: p_cc is descriptive"
