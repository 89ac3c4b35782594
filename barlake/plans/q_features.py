"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import features as f
from barlake.plans import fixtures as fx
from barlake.plans.registry import add

W = "OVER (PARTITION BY symbol ORDER BY timestamp)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full(expr: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) {rows(n)} = {n} THEN {expr} {rows(n)} END"


def pfull(expr: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) {prior(n)} = {n} THEN {expr} {prior(n)} END"


def z(col: str, n: int) -> str:
    return f"coalesce(({col} - avg({col}) {rows(n)}) / nullif(stddev_pop({col}) {rows(n)}, 0), 0)"


RET = f"""SELECT *, coalesce(close / lag(close) {W} - 1, 0) AS return_1, coalesce(ln(close / lag(close) {W}), 0) AS log_return_1,
 coalesce(open / lag(close) {W} - 1, 0) AS gap_return, coalesce((high - low) / nullif(close, 0), 0) AS range_pct,
 greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS true_range FROM bars"""

FEAT = f"""SELECT *, coalesce(close / nullif(sma_medium, 0) - 1, 0) AS trend_strength FROM (SELECT *,
 {full('avg(close)', 'close', 5)} AS sma_short, {full('avg(close)', 'close', 20)} AS sma_medium, {full('avg(close)', 'close', 50)} AS sma_long,
 coalesce({full('stddev_samp(log_return_1)', 'log_return_1', 20)}, 0) AS volatility,
 avg(true_range) {rows(20)} AS atr, {z('close', 20)} AS price_zscore,
 {full('avg(volume)', 'volume', 20)} AS volume_sma, {z('volume', 20)} AS volume_zscore,
 {full('max(high)', 'high', 20)} AS rolling_high, {full('min(low)', 'low', 20)} AS rolling_low FROM rets)"""

EMA = """/*RECURSIVE_MARK*/SELECT * FROM ema_rec"""
EMA_ROWS = "SELECT symbol, timestamp, day, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM bars"
EMA_REC = """/*RECURSIVE_MARK*/SELECT symbol, rn, close AS ema_fast, close AS ema_slow FROM ema_rows WHERE rn = 1
 UNION ALL SELECT b.symbol, b.rn, r.ema_fast * (9.0/11)::DOUBLE + b.close * (2.0/11)::DOUBLE,
 r.ema_slow * (39.0/41)::DOUBLE + b.close * (2.0/41)::DOUBLE FROM ema_rec r JOIN ema_rows b ON b.symbol = r.symbol AND b.rn = r.rn + 1"""
VIEWS = {"rets": RET, "feats": FEAT}
EMAS = {"ema_rows": EMA_ROWS, "ema_rec": EMA_REC}


def feature_query(name: str, nums: str, step) -> None:
    """A single feature family over the fixture bars, checked against the shared SQL view."""
    add(name, lambda s, d: step(f.bar_series(fx.bars(s, d), 50)).done(), f"SELECT symbol, day, {', '.join(nums.split())} FROM feats", "symbol day", nums, **VIEWS)


feature_query("f01_return_1", "return_1", f.add_returns)
feature_query("f02_log_return_1", "log_return_1", f.add_returns)
feature_query("f03_gap_return", "gap_return", f.add_returns)
feature_query("f04_range_pct", "range_pct", f.add_returns)
feature_query("f05_sma", "sma_short sma_medium sma_long", f.add_averages)
feature_query("f07_volatility", "volatility", lambda s: (lambda r: r.with_columns({"volatility": f.volatility(r)}))(f.add_returns(s)))
feature_query("f08_true_range_atr", "true_range atr", f.add_atr)
feature_query("f09_trend_strength", "trend_strength", lambda s: f.add_averages(s).with_columns({"trend_strength": f.trend_strength()}))
feature_query("f10_zscore", "price_zscore volume_zscore", lambda s: f.add_volume(s).with_columns({"price_zscore": f.zscore(s, "close", 20)}))
feature_query("f11_volume_sma", "volume_sma", f.add_volume)
feature_query("f12_rolling_high_low", "rolling_high rolling_low", f.add_channel)
add("f06_ema", lambda s, d: f.add_emas(f.bar_series(fx.bars(s, d), f.ema_lookback(40))).done(),
    "SELECT symbol, day, ema_fast, ema_slow FROM ema_rec JOIN ema_rows USING (symbol, rn)", "symbol day", "ema_fast ema_slow", digits=4, **EMAS)
add("f13_feature_available_at",
    lambda s, d: f.build_features(fx.bars(s, d), ema=False).withColumn("available", F.date_format("feature_available_at", "yyyy-MM-dd HH:mm:ss")),
    "SELECT symbol, day, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS available FROM bars", "symbol day available")
ALL = " ".join(f.FEATURE_COLUMNS)
add("f14_build_features", lambda s, d: f.build_features(fx.bars(s, d)),
    f"SELECT feats.symbol, feats.day, {', '.join(f.FEATURE_COLUMNS)} FROM feats JOIN ema_rows ON feats.symbol = ema_rows.symbol AND feats.timestamp = ema_rows.timestamp JOIN ema_rec ON ema_rec.symbol = ema_rows.symbol AND ema_rec.rn = ema_rows.rn",
    "symbol day", ALL, digits=4, **VIEWS, **EMAS)

# --- lagged, beta, oscillators, channels ------------------------------------------------
LIQ = f"""SELECT symbol, day, timestamp, close, volume, open, avg(volume) {prior(20)} AS lagged_adv, lag(close) {W} AS lagged_close,
 lag(close) {W} * avg(volume) {prior(20)} AS lagged_traded_value FROM bars"""
add("f15_lagged_liquidity", lambda s, d: f.lagged_liquidity(fx.bars(s, d)),
    "SELECT symbol, day, lagged_adv, lagged_close, lagged_traded_value FROM liq", "symbol day", "lagged_adv lagged_close lagged_traded_value", liq=LIQ)

PANEL_RET = f"""SELECT b.*, benchmark_close, close / nullif(lag(close) {W}, 0) - 1 AS rs, benchmark_close / nullif(lag(benchmark_close) {W}, 0) - 1 AS rb
 FROM bars b JOIN benchmark_bars USING (timestamp)"""


def beta_sql(n: int) -> str:
    return f"CASE WHEN count(rs) {rows(n)} = {n} THEN covar_samp(rs, rb) {rows(n)} / nullif(var_samp(rb) {rows(n)}, 0) END"


def panel(s, d):
    return fx.bars(s, d).join(fx.benchmark(s, d), "timestamp")


add("f16_rolling_beta", lambda s, d: f.add_beta(f.bar_series(panel(s, d), 61), 60).done(),
    f"SELECT symbol, day, {beta_sql(60)} AS beta FROM panel_ret", "symbol day", "beta", panel_ret=PANEL_RET)

DELTA = f"SELECT *, close - lag(close) {W} AS dl FROM bars"
UPDOWN = "SELECT *, CASE WHEN dl IS NOT NULL THEN greatest(dl, 0) END AS up, CASE WHEN dl IS NOT NULL THEN -least(dl, 0) END AS dn FROM deltas"


def rsi_sql(n: int) -> str:
    return f"100 - 100 / (1 + ({full('avg(up)', 'up', n)}) / nullif({full('avg(dn)', 'dn', n)}, 0))"


RSI = {"deltas": DELTA, "updown": UPDOWN}
add("f17_rsi", lambda s, d: f.add_rsi(f.bar_series(fx.bars(s, d), 14), 14).done(),
    f"SELECT symbol, day, {rsi_sql(14)} AS rsi FROM updown", "symbol day", "rsi", **RSI)
add("f18_bollinger", lambda s, d: f.add_bollinger(f.bar_series(fx.bars(s, d), 20)).done(),
    f"SELECT symbol, day, {full('avg(close)', 'close', 20)} AS band_mid, {full('avg(close)', 'close', 20)} - 2 * {full('stddev_pop(close)', 'close', 20)} AS band_low FROM bars",
    "symbol day", "band_mid band_low")
add("f19_donchian", lambda s, d: f.add_donchian(f.bar_series(fx.bars(s, d), 55), 55, 20).done(),
    f"SELECT symbol, day, {pfull('max(high)', 'high', 55)} AS prior_high, {pfull('min(low)', 'low', 20)} AS prior_low FROM bars", "symbol day", "prior_high prior_low")

WIDTH = f"SELECT *, 4 * {full('stddev_pop(close)', 'close', 20)} / nullif({full('avg(close)', 'close', 20)}, 0) AS band_width FROM bars"
THRESH = f"SELECT *, CASE WHEN count(band_width) {rows(100)} = 100 THEN quantile_cont(band_width, 0.25) {rows(100)} END AS th0 FROM widths"
NARROW = f"""SELECT *, lag(th0) {W} AS width_threshold,
 CAST(coalesce(lag(band_width) {W} <= lag(th0) {W}, false) AS INT) AS nar, row_number() {W} AS rn FROM thresholds"""
CONTRACT = f"SELECT *, rn >= 5 AND max(nar) {rows(5)} = 1 AS recently_contracted FROM narrows"
CONTRACTION = {"widths": WIDTH, "thresholds": THRESH, "narrows": NARROW, "contract": CONTRACT}
add("f20_band_contraction", lambda s, d: f.add_contraction(f.bar_series(fx.bars(s, d), 126)).done(),
    "SELECT symbol, day, recently_contracted, band_width, width_threshold FROM contract",
    "symbol day recently_contracted", "band_width width_threshold", **CONTRACTION)
add("f21_month_end_flag", lambda s, d: f.month_end_flag(fx.bars(s, d)),
    "SELECT symbol, day, timestamp = max(timestamp) OVER (PARTITION BY symbol, strftime(timestamp, '%Y-%m')) AS month_end FROM bars", "symbol day month_end")
add("f21_panel_month_end", lambda s, d: f.month_end_flag(fx.bars(s, d), per_symbol=False),
    "SELECT symbol, day, timestamp = max(timestamp) OVER (PARTITION BY strftime(timestamp, '%Y-%m')) AS month_end FROM bars", "symbol day month_end")
add("f22_n_period_return", lambda s, d: f.n_period_return(fx.bars(s, d), [5, 21, 252]),
    "SELECT symbol, day, " + ", ".join(f"close / nullif(lag(close, {p}) {W}, 0) - 1 AS ret_{p}" for p in (5, 21, 252)) + " FROM bars",
    "symbol day", "ret_5 ret_21 ret_252")
add("f23_date_zscore", lambda s, d: f.add_date_zscore(fx.bars(s, d), ["close", "volume"]),
    "SELECT symbol, day, (close - avg(close) OVER t) / nullif(stddev_samp(close) OVER t, 0) AS close_z, "
    "(volume - avg(volume) OVER t) / nullif(stddev_samp(volume) OVER t, 0) AS volume_z FROM bars WINDOW t AS (PARTITION BY timestamp)",
    "symbol day", "close_z volume_z")
PIT = """EXISTS (SELECT 1 FROM constituents c WHERE c.symbol = b.symbol AND c.effective_from <= b.d AND (c.effective_until IS NULL OR b.d < c.effective_until))"""
add("f24_build_panel",
    lambda s, d: f.build_panel(fx.bars(s, d), fx.benchmark(s, d), fx.constituents(s, d), ema=False),
    f"""SELECT b.symbol, b.day, b.sector, b.benchmark_close, b.price_zscore, b.atr, b.rn >= 253 AS eligible, {PIT} AS pit_eligible
     FROM (SELECT feats.*, benchmark_close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn
           FROM feats JOIN benchmark_bars USING (timestamp)) b""",
    "symbol day sector eligible pit_eligible", "benchmark_close price_zscore atr", **VIEWS)
add("f24_panel_problems",
    lambda s, d: f.panel_problems(
        fx.bars(s, d).withColumn("adjustment", F.when(F.col("symbol") == "NATION_0", "SPLIT_ADJUSTED").otherwise(F.col("adjustment"))).unionByName(
            fx.bars(s, d).filter("dayofmonth(timestamp) = 3")),
        fx.benchmark(s, d).withColumn("timestamp", F.expr("CASE WHEN dayofmonth(timestamp) = 4 THEN timestamp + INTERVAL '1' HOUR ELSE timestamp END"))),
    """SELECT 'DUPLICATE_KEYS' AS problem, count(*) AS rows FROM bars WHERE day(d) = 3
    UNION ALL SELECT 'MISSING_BENCHMARK', count(DISTINCT timestamp) FROM bars WHERE day(d) = 4
    UNION ALL SELECT 'MIXED_ADJUSTMENT', 2 FROM (SELECT 1 FROM bars WHERE symbol = 'NATION_0' LIMIT 1)""", "problem rows")
add("f26_time_split", lambda s, d: f.time_split(fx.bars(s, d), 0.7),
    "SELECT symbol, day, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY timestamp) <= greatest(1, least(count(*) OVER (PARTITION BY symbol) - 1, floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE))) THEN 'TRAIN' ELSE 'TEST' END AS part FROM bars",
    "symbol day part")
