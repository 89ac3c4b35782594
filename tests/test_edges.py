"""Fractional quantities, full smoothing, archives, scopes and bootstrap weights."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlake.functions.windows import add_smoothing, series
from barlake.operators import execution, metrics, signals
from barlake.session import ensure_checkpoint_dir
from barlake.sources.tables import archive_bars, replace_scope, upsert_ignore
from barlake.streaming.admission import admit_batch

DAY = dt.datetime(2020, 1, 1)


def fills(spark, sides):
    rows = [("r", "A", DAY + dt.timedelta(days=i), i, side, quantity, 10.0 + i, 0.0) for i, (side, quantity) in enumerate(sides)]
    return spark.createDataFrame(rows, "run_id string, symbol string, timestamp timestamp, fill_id long, side string, quantity double, price double, fees double")


@pytest.mark.parametrize("sides, trips", [
    ([("SELL", 0.9), ("BUY", 0.2), ("SELL", 0.2), ("BUY", 0.2), ("SELL", 0.2)], [(2, 0.2), (4, 0.2)]),
    ([("SELL", 3.7), ("BUY", 0.1), ("SELL", 0.1), ("SELL", 0.1)], [(2, 0.1)]),
    ([("BUY", 0.3), ("SELL", 0.1), ("SELL", 0.1), ("SELL", 0.1), ("BUY", 0.7), ("SELL", 0.7)], [(1, 0.1), (2, 0.1), (3, 0.1), (5, 0.7)]),
])
def test_ledger_of_fractions(spark, sides, trips):
    rows = execution.ledger_round_trips(execution.ledger(fills(spark, sides))).orderBy("trade_id").collect()
    assert [(r.trade_id, round(r.quantity, 9)) for r in rows] == trips
    assert rows[-1].entry_timestamp == DAY + dt.timedelta(days=max(i for i, (s, _) in enumerate(sides) if s == "BUY"))


def test_smoothing_without_memory(spark):
    df = spark.range(50).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), F.col("id").cast("double").alias("x"))
    done = add_smoothing(series(df, ["symbol"], ("timestamp",), lookback=2), "x", 1.0, "y").done()
    assert done.where("x <> y").count() == 0 and done.count() == 50


def bars(spark, first, last):
    return spark.createDataFrame([("A", "1d", DAY + dt.timedelta(days=i), 1.0) for i in range(first, last)], "symbol string, timeframe string, timestamp timestamp, close double")


def test_archive_keeps_what_a_trimmed_source_lost(spark, tmp_path):
    path, cutoff = str(tmp_path / "archive"), F.lit(DAY + dt.timedelta(days=40))
    assert archive_bars(bars(spark, 0, 30), cutoff, path) and archive_bars(bars(spark, 20, 50), cutoff, path) and not archive_bars(bars(spark, 20, 50), cutoff, path)
    assert spark.read.parquet(path).count() == 40


def test_scope_without_rows_is_cleared(spark, tmp_path):
    path = str(tmp_path / "scope")
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, fold_id string, x long")
    replace_scope(frame([("a", "1", 1), ("a:b", "2", 2), ("c", "3", 3)]), path)
    replace_scope(frame([("c", "3", 4)]), path, cleared=frame([("a:b", "2", 0), ("c", "3", 0)]))
    assert {(r.run_id, r.x) for r in spark.read.parquet(path).collect()} == {("a", 1), ("c", 4)}


def test_first_writer_is_the_same_on_every_retry(spark):
    target = spark.createDataFrame([(1, "old")], "k long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (2, "c")], "k long, v string")
    for parts in (1, 4):
        assert [tuple(r) for r in upsert_ignore(target, new.repartition(parts), ["k"]).collect()] == [(2, "a")]


def test_bootstrap_weights_are_independent_draws(spark):
    days = spark.range(2400).select(F.col("id").cast("string").alias("name"))
    for rep in (0, 1, 50, 199):
        w = [r[0] for r in days.select(metrics.bootstrap_weight(metrics.bootstrap_draw(F.col("name"), F.lit(rep)))).collect()]
        mean = sum(w) / len(w)
        lag = sum((a - mean) * (b - mean) for a, b in zip(w, w[1:], strict=False)) / sum((a - mean) ** 2 for a in w)
        assert abs(mean - 1) < 0.08 and abs(lag) < 0.08 and abs(sum((a - mean) ** 2 for a in w) / len(w) - 1) < 0.15


def test_sequence_carries_over_to_the_next_session(spark):
    noon = dt.datetime(2024, 1, 8, 6, 0)
    ticks = [(noon + dt.timedelta(days=d, seconds=i), n) for d, numbers in enumerate(((48, 49, 50), (1, 2, 3))) for i, n in enumerate(numbers)]
    rows = spark.createDataFrame(
        [("t", i, at, at, n, 100.0, 10 + i) for i, (at, n) in enumerate(ticks)],
        "token string, event_id long, exchange_timestamp timestamp, received_at timestamp, sequence_number long, ltp double, cumulative_volume long")
    got = [r.reasons for r in admit_batch(rows).orderBy("event_id").collect()]
    assert got == ["VALID_TICK"] * 4 + ["SEQUENCE_GAP_DETECTED,VALID_TICK"] * 2


def test_grid_is_whole(spark):
    rows = signals.with_grid(spark.range(2), {"b": range(7), "a": range(10), "c": (1, 2)}, {"c": 5}).collect()
    assert sorted((r.id, r.a, r.b, r.c, r.param_id) for r in rows) == [(i, a, b, 5, 7 * a + b) for i in range(2) for a in range(10) for b in range(7)]


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
