"""Every registered query against its SQL, over whole tables; those without SQL must run and keep their schema."""

import os

import duckdb
import pytest

from pulsewright import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return "null" if value is None else str(value)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in at) for r in rows)


#: Sequential steps, small solves and tails of distributions; every other query stays in the JVM.
PYTHON = {
    "greedy_bins", "greedy_epoch_count", "expand_bins", "solar_wind_rebin", "event_rebin", "early_era_bins", "dmx_setup_bins", "dmx_setup_cuts", "dmx_setup_windows", "dmx_setup_window_cuts", "bins_repaired", "weighted_linear_fit", "leave_one_file_out", "leave_one_file_out_line", "nested_model_tests", "nested_model_lines",
    "f_test_p_values", "f_test_of_two_terms", "chi2_tail_of_six", "reduced_chi2", "fit_uncertainties", "post_fit_residuals", "job_outlier_excision_tests", "job_outlier_excision_cuts",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and (name in PYTHON or not any(w in plan for w in ("Python", "Pandas", "Arrow")))
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert ordered(df.columns, rows) == ordered(columns, want.fetchall())
    else:
        assert rows


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["psr", "dim", "value", "total", "cut"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", ["curate_cut_counts", "cut_bad_toas", "simultaneous_overlap", "bin_members", "residual_rms", "tim_round_trip", "compare_models"])
def test_plans_stay_on_the_jvm_and_join_by_keys(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
