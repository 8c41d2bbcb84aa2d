import pytest
from compare import connect, same

from quantloom.plans import oracle, queries

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, name):
    same(QUERIES[name](spark, sf).toPandas(), connect(sf).sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["panel_violations", "evt_violations", "garch_evt_violations"])
def test_no_violations(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == 0


def test_every_query_without_sql_is_a_fit_or_a_check():
    assert set(QUERIES) - set(SQL) == {
        "evt_violations", "garch_evt_violations", "delta_t_normal", "evt_var", "evt_threshold_windows", "garch_fit", "garch_evt_var", "garch_evt_rolling", "fhs_var", "mc_gaussian_var", "mc_t_copula_var",
        "mc_garch_copula_var", "copula_gof_cvm", "garch_factors", "garch_selection", "garch_evt_thresholds", "garch_compare", "refit_sweep", "window_sweep", "compare_all_methods", "sign_bias_p", "arch_lm",
        "adf", "residual_families", "garch_criteria", "garch_summary_table", "garch_variance_table", "garch_candidates", "mc_factor_var", "crisis_table_tails", "delta_t_normal_tests", "method_backtests",
        "arma_orders", "garch_comparison", "vine_edges", "vine_fit", "copula_checks", "simulation_checks", "scenario_var", "scenario_shares", "sample_day",
        "evt_stability", "garch_stability", "pricing_validation_summary", "pricing_validation_worst",
    }
