"""Files in and out, and the shape of the physical plans."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators.learned import walk_forward_logistic
from barlake.plans import fixtures as fx
from barlake.plans import load_queries
from barlake.sources import bars as src
from barlake.sources import tables as tb
from tests.test_blocks import walk


def test_archive_and_partition_pruning(spark, tmp_path, sf):
    bars = fx.bars(spark, sf)
    path = str(tmp_path / "a")
    assert tb.archive_bars(bars, F.lit("1998-01-01").cast("timestamp"), path)
    one = src.read_bars(spark, path, "1d", ["NATION_20"]).filter("month = '1996-05'")
    assert one.count() == bars.filter("symbol = 'NATION_20' AND year(timestamp) = 1996 AND month(timestamp) = 5").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(symbol,NATION_20)" in plan and "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters")[1][:200]


def test_replace_scope_touches_one_run_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "run_id string, fold_id string, v int")
    tb.replace_scope(rows([("a", "1", 1), ("a", "1", 2), ("b", "1", 3)]), path)
    tb.replace_scope(rows([("a", "1", 9)]), path)
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,close\n2020-01-01,1.5\n2020-01-02,2.5\n")
    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType())])
    df = src.read_csv_checked(spark, str(tmp_path / "x.csv"), schema, ["timestamp", "close"], {"date": "timestamp"})
    assert df.count() == 2
    with pytest.raises(ValueError, match="volume"):
        src.read_csv_checked(spark, str(tmp_path / "x.csv"), schema, ["volume"])
    (tmp_path / "a.json").write_text(json.dumps([{"symbol": "A", "ex_date": "2020-01-01", "action_type": "SPLIT", "share_multiplier": 2.0}]))
    assert src.read_actions_json(spark, str(tmp_path / "a.json")).first().share_multiplier == 2.0
    tb.write_report_csv(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2


def test_append_new_keeps_first_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "old")], "k int, v string").write.parquet(path)
    tb.append_new(spark, path, spark.createDataFrame([(1, "new"), (2, "x"), (2, "x")], "k int, v string"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "old"), (2, "x")]


PLANNED = ["f14_build_features", "g05_donchian_trend", "g14_residual_momentum", "q19_quality_report", "ca07_adjust_back", "u04_mark_pit", "x07_vector_backtest", "m02_var_cvar", "s15_mark_untrusted"]


@pytest.mark.parametrize("name", PLANNED)
def test_no_single_task_or_nested_loop(spark, sf, name):
    plan = load_queries()[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    lines = plan.splitlines()
    gathered = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    assert all("Aggregate(keys=[]" in line for line in gathered)  # only pre-aggregated totals meet in one task


def test_symbol_windows_are_always_cut_into_blocks(spark, sf):
    plan = load_queries()["f14_build_features"].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.rsplit("[symbol", 1)[1].split("]")[0] for line in plan.splitlines() if "Window [" in line and "], [symbol" in line]
    rows = [k for k in keys if "_block" not in k and "_chunk" not in k]
    assert keys and len(rows) <= 1  # only the per-chunk summary is ordered over a whole symbol


def test_walk_forward_scores_rank_every_rebalance(spark):
    import pandas as pd

    panel = spark.createDataFrame(pd.concat([walk(420, s, i) for i, s in enumerate("ABCDEF")]))
    out = walk_forward_logistic(panel, minimum=300).toPandas()
    assert len(out) and out["score"].between(0, 1).all() and (out.groupby("timestamp")["rank"].min() == 1).all()
