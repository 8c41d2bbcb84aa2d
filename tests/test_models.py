"""Selection, criteria, scenarios, sweeps, dependence and the basis of comparisons, each against a plain statement of it."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import schema as S
from quantloom.functions import kernels as K
from quantloom.functions import volatility as G
from quantloom.operators import book, dependence, diagnostics, monte_carlo, panel, scenarios, selection
from quantloom.operators.once import once
from quantloom.plans import queries as Q
from test_engine import series
from test_volatility import drawn


@pytest.fixture(scope="module")
def lv(spark, sf):
    return once(Q.levels(spark, sf))


# --- one P&L ------------------------------------------------------------------------------------------------------------------------------


def test_all_methods_are_held_against_the_books_own_pnl(spark, lv):
    want = {r.d: r.pnl_total for r in book.pnl(lv).collect()}
    for d in (Q.two_methods(lv), Q.dn_backtest(lv), Q.against(Q.evt_var(lv), Q.total_pnl(lv)), Q.against(Q.fhs_var(lv), Q.total_pnl(lv)), Q.delta_t_normal(lv)):
        rows = d.select("d", "pnl").collect()
        assert rows and all(r.pnl == want[r.d] for r in rows)
    assert {r.d: r.loss for r in Q.portfolio_losses(lv).collect()} == {k: -v for k, v in want.items()}
    assert all(r.r * S.V0 == pytest.approx(want[r.d]) for r in Q.series(lv).collect())
    linear = {r.d: r.pnl_linear for r in book.pnl(lv).collect()}
    assert all(r.pnl == linear[r.d] for r in Q.dn_linear(lv).collect())


# --- selection ----------------------------------------------------------------------------------------------------------------------------


def test_every_candidate_is_gated(spark):
    """The fourth by AIC is chosen where it alone passes; the first where none does."""
    rows = [("main", "a", "garch", f"l{k}", float(k), 0.2 if k == 4 else 0.01) for k in range(1, 6)] + [("main", "b", "garch", f"l{k}", float(k), 0.05) for k in range(1, 6)]
    d = spark.createDataFrame(rows, "book string, factor string, model string, law string, aic double, gof_min double")
    assert {r.factor: (r.aic, r.passed) for r in selection.selected(d).collect()} == {"a": (4.0, True), "b": (1.0, False)}


@pytest.fixture(scope="module")
def simulated(spark):
    a, b = drawn("gjr", "sstd", (0.8, 7.0), 1500, alpha=0.03, gamma=0.12, omega=0.08) * 0.01, np.random.default_rng(1).standard_normal(1500)
    b[750:] *= 4
    return spark.createDataFrame([("main", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "book string, i long, a double, b double")


@pytest.fixture(scope="module")
def fitted(simulated):
    return once(selection.fits(simulated, ["a", "b"]))


def test_all_models_and_laws_are_fitted(fitted, simulated):
    rows = fitted.collect()
    assert len(rows) == 2 * 28 and len({(r.factor, r.model, r.law) for r in rows}) == 56
    x = np.array([r.a for r in simulated.orderBy("i").collect()])
    for r in rows:
        if r.factor != "a":
            continue
        e = x - r.mu
        s = G.variance(r.model, e[:, None], r.omega, r.alpha, r.beta, r.gamma, r.delta, G.laws.mean_abs(r.law, tuple(v for v in (r.skew, r.shape) if v is not None)))[:-1, 0]
        p = tuple(v for v in (r.skew, r.shape) if v is not None)
        ll = (G.laws.LAWS[r.law].logpdf(e / np.sqrt(s), *p) - 0.5 * np.log(s)).sum()
        assert r.loglik == pytest.approx(ll, abs=0.5) and r.aic == pytest.approx(2 * r.parameters - 2 * r.loglik)  # in the series' own units
    best = selection.selected(fitted).where("factor = 'a'").first()
    assert best.passed and best.law in ("sstd", "jsu", "nig") and best.model in ("gjr", "aparch", "egarch")
    assert len(selection.candidates(fitted).collect()) == 6


def test_criteria_are_the_tests_they_name(fitted):
    chosen = selection.selected(fitted)
    got = {r.factor: r for r in selection.criteria(chosen).collect()}
    z = {r.factor: np.array(r.z) for r in chosen.collect()}
    assert got["a"].c1 == pytest.approx(K.weighted_ljung_box(z["a"], 10)[1], rel=1e-6)
    assert got["a"].c2 <= K.weighted_ljung_box(z["a"] ** 2, 10, 2)[1] + 1e-9
    assert all(got["a"][f"pass_c{k}"] for k in (1, 2, 3, 6))
    assert not (got["b"].pass_c6 and got["b"].pass_c4 and got["b"].pass_c3)  # its variance changes once
    texts = selection.summary_table(selection.criteria(chosen)).collect()
    assert {t.mean for t in texts} == {"ARMA(0,0)"} and all(t.c1 in ("pass", "fail") for t in texts) and selection.variance_table(selection.criteria(chosen)).count() == 2


def test_orders_reach_the_fits(spark):
    x = drawn("garch", "std", (8.0,), 1500, ar=0.5)
    d = spark.createDataFrame([("main", i, float(v)) for i, v in enumerate(x)], "book string, i long, a double")
    orders = selection.arma_orders(d, ["a"], most=2)
    assert orders.count() == 9 and [r["rank"] for r in orders.orderBy("aic").collect()] == list(range(1, 10))
    first = orders.where("rank = 1").first()
    assert first.p >= 1 and first.lb_p > 0.001
    f = selection.fits(d, ["a"], ("garch",), ("std",), orders.where("p = 1 and q = 0")).first()
    assert f.ar[0] == pytest.approx(0.5, abs=0.08) and f.parameters == 6


def test_families_of_residuals(spark):
    z = G.laws.ppf("jsu", np.random.default_rng(3).random(4000), -1.0, 1.5)
    d = spark.createDataFrame([("main", "a", [float(v) for v in z])], "book string, factor string, z array<double>")
    got = {r.family: r for r in selection.residual_families(d).collect()}
    assert len(got) == 7 and sum(r.chosen for r in got.values()) == 1 and got["JSU"]["rank"] == 1 and got["JSU"].chosen and got["JSU"].ks_p > 0.05 > got["NO"].ks_p


# --- scenarios ----------------------------------------------------------------------------------------------------------------------------


def test_figures_are_aggregates_of_one_table(spark, lv, tmp_path):
    few = {"draws": 400}
    model = monte_carlo.t_copula_model(lv, **few)
    t = scenarios.table(model, str(tmp_path / "s"))
    days = model.rows.count()
    assert t.count() == 400 * days and {p.name for p in (tmp_path / "s").glob("year=*/book=*")} == {"book=main"}
    own = {r.i: (r["var"], r.mean_pnl, r.std_pnl) for r in monte_carlo.t_copula(lv, **few).collect()}
    got = {r.i: (r.var_99, r.mean_pnl, r.std_pnl) for r in scenarios.figures(t).collect()}
    assert got.keys() == own.keys() and all(got[k][0] == pytest.approx(own[k][0], rel=1e-9) for k in own)
    sure = [k for k in own if own[k][2] is not None and math.isfinite(own[k][2])]  # on this small panel some draws overflow
    assert sure and all(got[k] == pytest.approx(own[k], rel=1e-6) for k in sure)
    con = duckdb.connect()
    con.sql(f"create view s as select * from read_parquet('{tmp_path}/s/*/*/*.parquet', hive_partitioning=true)")
    want = con.sql("""with q as (select *, -quantile_cont(pnl_total, 0.01) over (partition by i) as v from s)
        select i, any_value(v), avg(-pnl_total), avg(-pnl_linear), avg(-pnl_irs), avg(-pnl_straddle) from q where pnl_total <= -v group by i order by i""").fetchall()
    rows = scenarios.shares(t).orderBy("i").collect()
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        assert (r.i, r["var"], r.es, r.es_linear, r.es_irs, r.es_straddle) == pytest.approx(w, rel=1e-9) and r.es_linear + r.es_irs + r.es_straddle == pytest.approx(r.es)
    day = str(t.agg(F.max("d")).first()[0])
    one = scenarios.day_slice(t, day, 5)
    assert [tuple(r) for r in one.select("rank", "draw", "pnl_total").orderBy("rank").collect()] == con.sql(f"select row_number() over (order by pnl_total, draw), draw, pnl_total from s where d = '{day}' order by pnl_total, draw limit 5").fetchall()
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()
    st = {r.confidence: r for r in scenarios.static(t.where(F.col("i") == sure[0]), {0.95: Q.Z_95, 0.99: S.Z_ALPHA}).collect()}
    v, m, sd = con.sql(f"select -quantile_cont(pnl_total, 0.05), avg(pnl_total), stddev_samp(pnl_total) from s where i = {sure[0]}").fetchall()[0]
    assert st[0.95]["var"] == pytest.approx(v) and st[0.95].var_normal == pytest.approx(Q.Z_95 * sd - m) and st[0.99].es >= st[0.99]["var"]


def test_days_of_simulations_carry_no_windows(lv):
    for m in (monte_carlo.gaussian_model(lv), monte_carlo.t_copula_model(lv), monte_carlo.garch_copula_model(lv, monte_carlo.garch_copula_fits(lv))):
        r = m.rows.limit(1).toPandas().iloc[0]
        assert max(len(v) for v in r if hasattr(v, "__len__") and not isinstance(v, str)) <= 50 * 6


def test_gaussian_draws_have_the_windows_moments(lv):
    m = monte_carlo.gaussian_model(lv)
    row = m.rows.orderBy("i").limit(1).collect()[0]
    w = np.array([[r[c] for c in panel.SHOCKS] for r in panel.mc_shocks(lv).where((F.col("i") < row.i) & (F.col("i") >= row.i - 750)).orderBy("i").collect()])
    assert row.mean == pytest.approx(w.mean(0).tolist()) and row.cov == pytest.approx(np.cov(w, rowvar=False)[np.triu_indices(6)].tolist())


# --- sweeps -------------------------------------------------------------------------------------------------------------------------------


def test_frequencies_share_their_fits(lv):
    rows, fits = monte_carlo.refit_sweep(lv, (50, 100), draws=200)
    days = monte_carlo.days(lv).count()
    assert fits.count() == math.ceil(days / 50)  # those of every 100 days are among them
    for every in (50, 100):
        own = {r.i: r["var"] for r in monte_carlo.garch_copula(lv, every=every, draws=200).collect()}
        assert {r.i: r["var"] for r in rows[every].collect()} == pytest.approx(own)


# --- dependence ---------------------------------------------------------------------------------------------------------------------------


def copula_rows(spark, nu, n=2500, seed=1):
    r = np.array([[1, 0.6, 0.3], [0.6, 1, 0.4], [0.3, 0.4, 1]])
    u = K.t_copula_sample(r, nu, n, np.random.default_rng(seed))
    return r, u, spark.createDataFrame([("main", i, *map(float, row)) for i, row in enumerate(u)], "book string, i long, a double, b double, c double")


def test_a_true_copula_passes_and_a_wrong_nu_fails(spark):
    _, _, d = copula_rows(spark, 3)
    true, wrong = dependence.copula_checks(d, ["a", "b", "c"]).collect(), dependence.copula_checks(d, ["a", "b", "c"], nu=20.0).collect()
    assert len(true) == 3 and all(r.ks_p > 0.01 and abs(r.tau_before) < 0.05 for r in true) and true[0].pooled_p > 0.01 and 2 <= true[0].nu <= 5
    assert wrong[0].pooled_p < 0.01


def test_rosenblatt_is_the_conditional_law():
    r = np.array([[1, 0.6, 0.3], [0.6, 1, 0.4], [0.3, 0.4, 1]])
    u = K.t_copula_sample(r, 4, 40_000, np.random.default_rng(2))
    e = dependence.rosenblatt(u, r, 4)
    near = np.abs(u[:, 0] - 0.9) < 0.02
    assert all(K.ks_p(K.ks_against(e[:, j], lambda v: v), len(e)) > 0.01 for j in range(3)) and K.ks_p(K.ks_against(e[near, 1], lambda v: v), int(near.sum())) > 0.01


def test_vines_of_columns(spark):
    r, u, d = copula_rows(spark, 4)
    rows = dependence.vine(d, ["c", "a", "b"]).collect()
    assert [(e.tree, e.a, e.b, e.given) for e in rows if e.tree == 1] == [(1, "a", "b", ""), (1, "b", "c", "")] and [(e.a, e.b, e.given) for e in rows if e.tree == 2] == [("a", "c", "b")]
    assert all(e.family == "t" for e in rows if e.tree == 1)
    f = dependence.vine_fit(dependence.vine(d, ["c", "a", "b"]), d.groupBy("book").agg(F.count("*").alias("n"))).first()
    assert f.edges == 3 and f.aic == pytest.approx(sum(e.aic for e in rows)) and f.n == 2500


def test_realised_moves_of_the_model_itself_are_uniform_places(spark, lv):
    m = monte_carlo.gaussian_model(lv, draws=400)
    own = monte_carlo.gaussian_model(lv, draws=1, seed=7)
    rows = [(r.book, r.i, *own.draw(r)[0].tolist()) for r in own.rows.collect()]
    moves = spark.createDataFrame(rows, "book string, i long, " + ", ".join(f"{c} double" for c in panel.SHOCKS))
    true = dependence.simulation_checks(m.rows.withColumn("refit", F.lit(0)), m.draw, moves, panel.SHOCKS).collect()
    wide = dependence.simulation_checks(m.rows.withColumn("refit", F.lit(0)), m.draw, moves.withColumn("s_a", F.col("s_a") * 3), panel.SHOCKS).where("column = 's_a'").first()
    assert len(true) == 6 and sum(r.ks_p > 0.05 for r in true) >= 5 and wide.ks_p < 0.01


# --- unit roots ---------------------------------------------------------------------------------------------------------------------------


def test_unit_root_table_at_its_nodes_and_between(spark):
    cases = [(t, n, p) for n, row in zip(diagnostics.DF_SIZES, diagnostics.DF_QUANTILES) for t, p in zip(row, diagnostics.DF_PROBABILITIES)]
    cases += [(-9.0, 100, 0.01), (3.0, 100, 0.99), (-4.38, 10, 0.01), ((-3.60 - 3.24) / 2, 25, 0.075), ((-3.60 - 3.50) / 2, 37.5, 0.05)]
    d = spark.createDataFrame([(float(t), float(n), p) for t, n, p in cases], "t double, n double, want double")
    assert all(r.p == pytest.approx(r.want, abs=1e-9) for r in d.withColumn("p", diagnostics.dickey_fuller_p(F.col("t"), F.col("n"))).collect())


def test_books_of_several_sizes_have_their_own_lags(spark):
    _, a = series(spark, 400)
    _, b = series(spark, 80, seed=5)
    got = {r.book: r for r in diagnostics.dickey_fuller(a.unionByName(b.withColumn("book", F.lit("small"))), "z").collect()}
    assert got["main"].lags == 7 and got["small"].lags == 4 and got["main"].p == 0.01
