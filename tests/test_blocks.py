"""Block-wise computation must not depend on where blocks and chunks are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.functions import windows as w
from barlake.operators import execution as x
from barlake.operators import features as ft
from barlake.operators import signals as g


def walk(n: int, symbol: str, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    spread = rng.uniform(0.001, 0.02, n)
    return pd.DataFrame({
        "symbol": symbol, "timestamp": pd.date_range("2020-01-01 03:45", periods=n, freq="D"), "open": close * (1 + rng.normal(0, 0.005, n)),
        "high": close * (1 + spread), "low": close * (1 - spread), "close": close, "volume": rng.integers(100, 10_000, n)})


@pytest.fixture(scope="module")
def frame():
    return pd.concat([walk(700, "A", 1), walk(90, "B", 2), walk(3, "C", 3)], ignore_index=True)


@pytest.fixture(params=[(65_536, 730), (64, 20)], ids=["one block", "many blocks"])
def cut(request, monkeypatch):
    rows, days = request.param
    monkeypatch.setattr(w, "BLOCK_ROWS", rows)
    monkeypatch.setattr(w, "CHUNK_SECONDS", days * 86_400)
    return rows


def pull(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_features_match_pandas(spark, frame, cut):
    got = pull(ft.build_features(spark.createDataFrame(frame)), "symbol", "timestamp")
    for symbol, part in frame.groupby("symbol"):
        mine = got[got.symbol == symbol].reset_index(drop=True)
        close = part["close"].reset_index(drop=True)
        pd.testing.assert_series_equal(mine["sma_long"], close.rolling(50).mean(), check_names=False, rtol=1e-9)
        pd.testing.assert_series_equal(mine["ema_slow"], close.ewm(span=40, adjust=False).mean(), check_names=False, rtol=1e-11)
        pd.testing.assert_series_equal(mine["return_1"], close.pct_change().fillna(0.0), check_names=False)


def test_growth_and_running(spark, frame, cut):
    df = ft.n_period_return(spark.createDataFrame(frame), [1])
    got = pull(w.growth(df, "symbol", ("timestamp",), "ret_1", 100.0), "symbol", "timestamp")
    for symbol, part in frame.groupby("symbol"):
        level = 100 * (1 + part["close"].pct_change().fillna(0)).cumprod().to_numpy()
        mine = got[got.symbol == symbol]
        np.testing.assert_allclose(mine["equity"], level, rtol=1e-9)
        np.testing.assert_allclose(mine["drawdown"], level / np.maximum.accumulate(level) - 1, atol=1e-9)


def slow_latch(part, enter, leave, atr, mult=3.0):
    pos, price, out = 0.0, 0.0, []
    for c, e, q, a in zip(part["close"], enter, leave, atr):
        if pos and a > 0 and price > 0 and c <= price - mult * a:
            pos, price = 0.0, 0.0
        elif not pos and e:
            pos, price = 1.0, c
        elif pos and q:
            pos, price = 0.0, 0.0
        out.append(pos)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_latch_matches_row_loop(spark, cut, seed):
    part = walk(400, "A", 10 + seed)
    rng = np.random.default_rng(seed)
    part["e"], part["q"] = rng.random(400) < 0.05, rng.random(400) < (0.004 if seed % 2 else 0.05)
    part["atr"] = np.where(rng.random(400) < 0.9, part["close"] * 0.02, np.nan)
    df = spark.createDataFrame(part).withColumn("atr", F.when(~F.isnan("atr"), F.col("atr")))
    got = pull(g.latch(df, F.col("e"), F.col("q"), "in", "out"), "timestamp")
    assert got["latched"].tolist() == slow_latch(part, part["e"], part["q"], part["atr"])


def test_ledger_matches_row_loop(spark, cut):
    rng = np.random.default_rng(5)
    n = 500
    f = pd.DataFrame({
        "run_id": "r", "symbol": "A", "timestamp": pd.date_range("2020-01-01", periods=n, freq="6h"), "fill_id": [f"{i:05d}" for i in range(n)],
        "side": np.where(rng.random(n) < 0.5, "BUY", "SELL"), "quantity": rng.integers(1, 20, n).astype(float), "price": rng.uniform(50, 150, n), "fees": rng.uniform(0, 2, n)})
    got = pull(x.ledger(spark.createDataFrame(f)), "fill_id")
    q = a = pool = 0.0
    start = None
    for i, r in f.iterrows():
        if r.side == "BUY":
            start = r.timestamp if q <= 0 else start
            a, q, pool = (q * a + r.quantity * r.price) / (q + r.quantity), q + r.quantity, pool + r.fees
            want = (a, 0.0, start)
        else:
            closed = min(r.quantity, q)
            cost = pool * closed / max(q, 1e-12)
            want = (a, (r.price - a) * closed, start)
            q, pool = q - closed, pool - cost
            if q == 0:
                a, pool, start = 0.0, 0.0, None
        assert got["average_cost"][i] == pytest.approx(want[0]) and got["gross_pnl"][i] == pytest.approx(want[1])
        assert (pd.isna(got["entry_timestamp"][i]) and want[2] is None) or got["entry_timestamp"][i] == want[2]


def test_asof_takes_latest_known(spark, cut):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, s int").select("k", F.timestamp_seconds("s").alias("t"))
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 10, 2.0)], "k string, s int, v double").select("k", F.timestamp_seconds("s").alias("u"), "v")
    at = {r.t.second: r.v for r in w.asof(left, right, "k", "t", "u", ["v"]).filter("k = 'a'").collect()}
    assert at == {5: 1.0, 10: 2.0}
    before = {r.t.second: r.v for r in w.asof(left, right, "k", "t", "u", ["v"], strict=True).filter("k = 'a'").collect()}
    assert before == {5: 1.0, 10: 1.0}


def hot_fills(n: int) -> pd.DataFrame:
    """One run and symbol with a busy day and sparse years, and a small second symbol."""
    rng = np.random.default_rng(5)
    start = pd.Timestamp("2020-01-01 04:00")
    at = [start + pd.Timedelta(days=3 * i) if i < n // 2 else start + pd.Timedelta(days=2 * n, seconds=int(i // 3)) for i in range(n)]
    hot = pd.DataFrame({"symbol": "H", "timestamp": at})
    both = pd.concat([hot, pd.DataFrame({"symbol": "S", "timestamp": at[:5]})], ignore_index=True)
    side = np.where(rng.random(len(both)) < 0.55, "BUY", "SELL")
    return both.assign(run_id=1, fill_id=np.arange(len(both)), side=side, quantity=rng.integers(1, 9, len(both)).astype(float), price=rng.uniform(50, 150, len(both)), fees=rng.uniform(0, 2, len(both)), reason=rng.choice(["A", "B"], len(both)))


def test_chunks_are_bounded_dense_and_ordered(spark):
    got = w.packed_chunks(spark.createDataFrame(hot_fills(2000)), ("run_id", "symbol"), "timestamp", 50).toPandas()
    assert len(got) == 2005
    for _, part in got.groupby("symbol"):
        part = part.sort_values(["timestamp", "fill_id"])
        assert part[w.CHUNK].is_monotonic_increasing and set(part[w.CHUNK]) == set(range(part[w.CHUNK].max() + 1))
        assert part[w.CHUNK].value_counts().max() < 100 and part.groupby("timestamp")[w.CHUNK].nunique().max() == 1


def test_ledger_does_not_depend_on_its_chunks(spark):
    fills = spark.createDataFrame(hot_fills(1200))
    one, many = (pull(x.ledger(fills, drag_bps=3.0, block_rows=n), "symbol", "fill_id") for n in (65_536, 40))
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)
    plain, cut_up = (pull(x.trade_pnls(fills, block_rows=n), "symbol", "fill_id") for n in (65_536, 40))
    pd.testing.assert_frame_equal(plain, cut_up, rtol=1e-9)
    average, held = 0.0, 0.0  # the plain loop
    for r in one[one.symbol == "H"].itertuples():
        if r.side == "BUY":
            average = (average * held + r.quantity * r.price) / (held + r.quantity)
            held += r.quantity
            assert abs(r.average_cost - average) < 1e-8
        else:
            assert abs(r.closed_quantity - min(r.quantity, held)) < 1e-9 and (held == 0 or abs(r.average_cost - average) < 1e-8)
            held = max(held - r.quantity, 0.0)
            average = average if held > 0 else 0.0


def test_closed_positions_make_no_rows(spark):
    day = lambda d: pd.Timestamp(f"2024-01-{d:02d} 04:00").to_pydatetime()
    fills = spark.createDataFrame([(1, "A", day(2), "BUY", 5.0), (1, "A", day(4), "SELL", 5.0), (1, "A", day(5), "BUY", 2.0), (2, "A", day(9), "BUY", 1.0), (1, "B", day(1), "BUY", 1.0)], "run_id int, symbol string, timestamp timestamp, side string, quantity double")
    bars = spark.createDataFrame([(s, day(d), float(d)) for d in (1, 2, 3, 4, 5, 6) for s in "AB" if s == "A" or d in (2, 4)], "symbol string, timestamp timestamp, close double")
    got = {(r.run_id, r.symbol, r.date.day, r.quantity, r.price) for r in x.positions_at_close(fills, bars).collect()}
    assert got == {(1, "A", 2, 5.0, 2.0), (1, "A", 3, 5.0, 3.0), (1, "A", 5, 2.0, 5.0), (1, "A", 6, 2.0, 6.0), *[(1, "B", d, 1.0, float(d // 2 * 2)) for d in (2, 3, 4, 5, 6) if d < 5], (1, "B", 5, 1.0, 4.0), (1, "B", 6, 1.0, 4.0)}
