"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barlake.plans import load_queries  # noqa: E402
from barlake.session import local_session  # noqa: E402

HEADLINE = (
    "trend_rule_report", "f14_build_features", "f23_date_zscore", "g11_cross_sectional_momentum", "g05_donchian_trend", "g21_rank_and_weight",
    "x07_vector_backtest", "x08_ledger", "m01_metrics", "m02_var_cvar", "q19_quality_report", "q03_validate_raw", "ca07_adjust_back",
    "u04_mark_pit", "r01_return_correlation", "wf2_select_parameters", "p3_cost_stress", "s08_tick_bars", "s05_admit_stateful_batch",
)


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_queries()
    timed(registered["u15_coverage"], spark, sf_dir)
    seconds = {n: round(statistics.median(timed(registered[n], spark, sf_dir) for _ in range(repeats)), 3) for n in names}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cores, "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
