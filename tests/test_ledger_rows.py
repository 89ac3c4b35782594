"""Ledgers and what reads numbered fills: results against SQL, and rows that are not shuffled more than needed."""

import os
import time

import pytest
from barlake import session
from barlake.functions import windows as w
from barlake.plans import fixtures as fx
from barlake.plans import load_queries
from pyspark.sql import functions as F

from tests.test_blocks import hot_fills
from tests.test_oracle import duck, test_matches_sql as matches_sql  # noqa: F401


@pytest.mark.parametrize("name", ["x09_round_trips", "x10_trade_pnls", "m05_trade_stats", "wf4_fold_slice"])
def test_matches(spark, duck, sf, name):  # noqa: F811
    matches_sql(spark, duck, sf, name)


def test_chunks_are_found_without_a_shuffle(spark):
    rows = spark.createDataFrame(hot_fills(2000))
    got = w.packed_chunks(rows, ("run_id", "symbol"), "timestamp", 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and got.agg(F.max(w.CHUNK)).first()[0] > 10
    assert got.count() == rows.count()


def test_numbered_fills_shuffle_values_once(spark, sf):
    """Of a line's quantity and price only the values in the table cross the shuffle of the numbering, once each."""
    plan = fx.fills(spark, sf, numbered=True)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ") :]
    assert "named_struct" not in window and "l_tax" in window and " AS fees" not in window and " AS price" not in window


def shuffled(spark) -> dict[str, int]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_ledger_keeps_one_copy_of_its_rows(spark, sf):
    """A ledger deletes the shuffled and the stored fills when it has them in order, and shuffles no rows from there on."""
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    stages, before = set(os.listdir(folder)), set(shuffled(spark))
    booked = load_queries()["x08_ledger"].run(spark, sf)
    plan = booked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    rows = [d for d in set(os.listdir(folder)) - stages if "quantity" in spark.read.parquet(f"{folder}/{d}").columns]
    assert len(rows) == 1 and "l_orderkey" not in spark.read.parquet(f"{folder}/{rows[0]}").columns
    deadline = time.time() + 20
    while (left := sum(size for name, size in shuffled(spark).items() if name not in before)) > 50_000 and time.time() < deadline:
        time.sleep(0.5)
    assert left <= 50_000


@pytest.mark.parametrize("name", ["x08_ledger", "x10_trade_pnls"])
def test_slices_match(spark, duck, sf, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(session, "SLICE_BYTES", 30_000)
    assert session.slices(fx.table(spark, sf, "lineitem")) > 2
    matches_sql(spark, duck, sf, name)


def test_equal_times_and_nulls_are_numbered_in_order(spark):
    """Without numbers fills are ordered by their ties, nulls first, and numbered along the run."""
    from barlake.operators import execution as x

    rows = [("r", s, day, tie, "BUY", 1.0, 2.0, 0.0) for s in "BA" for day in (2, 1) for tie in (3, None, 1)]
    fills = spark.createDataFrame(rows, "run_id string, symbol string, day int, tie int, side string, quantity double, price double, fees double")
    fills = fills.withColumn("timestamp", F.timestamp_seconds(F.col("day") * 86_400)).drop("day")
    values = {c: F.col(c) for c in ("side", "quantity", "price", "fees")} | {"at": F.col("tie")}
    got = x.ledger(fills, ties=["tie"], values=values, block_rows=2, parts=2).orderBy("fill_no").collect()
    assert [(r.fill_no, r.symbol, r.timestamp.day, r.at) for r in got] == [
        (i + 1, s, d, tie) for i, (d, s, tie) in enumerate((d, s, tie) for d in (2, 3) for s in "AB" for tie in (None, 1, 3))]
