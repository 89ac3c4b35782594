"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One query per operator family; the full set is run by the driver.
CHOSEN = [
    "trend_rule_report", "f06_ema", "f14_build_features", "f20_band_contraction", "f24_build_panel", "g02_mean_reversion_short", "g05_donchian_trend",
    "g11_cross_sectional_momentum", "g24_cap_weights", "q03_validate_raw", "q19_quality_report", "q16_check_missing_bars", "ca07_adjust_back", "ca10_detect_basis",
    "cal2_session_flags", "u04_mark_pit", "u08_readiness", "x02_cost_breakdown", "x08_ledger", "x17_risk_decide", "m02_var_cvar", "m03_bootstrap_sharpe",
    "r01_return_correlation", "r02_clusters", "wf1_walk_forward_folds", "p1_promotion_gates", "s01_decode_packets", "s05_admit_stateful_batch", "s08_tick_bars_stream", "s15_mark_untrusted",
    "q04_quarantine_valid", "u05_pit_coverage", "p7_certify_runs", "io04_read_actions_json", "io06_archive_bars", "io14_write_report_csv", "io15_replace_scope", "s05_stream", "s12_stream", "s14_stream",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, sf, name):
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cursor = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cursor.fetchall())
    assert got == want and got


def test_registry_is_complete():
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(queries) - set(entry_module.EXTRA) - set(oracle) == {"g19c_walk_forward_logistic", "q05_dataset_hash"}


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
