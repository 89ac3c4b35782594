"""Signal and sizing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import features as f
from barlake.operators import signals as g
from barlake.plans import fixtures as fx
from barlake.plans import q_features as q
from barlake.plans.registry import add

W, full, pfull, rows = q.W, q.full, q.pfull, q.rows
LABEL = "CASE WHEN target_position > 0 THEN 'LONG' WHEN target_position < 0 THEN 'SHORT' ELSE 'FLAT' END AS signal"

add("g00_signal_frame",
    lambda s, d: g.signal_frame(f.n_period_return(fx.bars(s, d), [5]).withColumn("target_position", F.col("ret_5") * 3), snapshot=["ret_5"]),
    f"""SELECT symbol, day, {LABEL}, target_position, target_position AS target_weight FROM (
    SELECT symbol, day, greatest(-1, least(1, coalesce(3 * (close / nullif(lag(close, 5) {W}, 0) - 1), 0))) AS target_position FROM bars)""",
    "symbol day signal", "target_position target_weight")

TREND = f"""SELECT e.symbol, e.rn, ema_rows.day, ema_rows.timestamp, feats.close, feats.open,
 CASE WHEN ema_fast > ema_slow AND volatility >= 0.01 THEN 1.0 ELSE 0.0 END AS target_position
 FROM ema_rec e JOIN ema_rows ON e.symbol = ema_rows.symbol AND e.rn = ema_rows.rn
 JOIN feats ON feats.symbol = e.symbol AND feats.timestamp = ema_rows.timestamp"""
TREND_VIEWS = {**q.VIEWS, **q.EMAS, "trend": TREND}


def trend(s, d):
    return g.trend_following(f.build_features(fx.bars(s, d)), min_volatility=0.01)


add("g01_trend_following", trend,
    f"SELECT symbol, day, {LABEL}, CASE WHEN target_position > 0 THEN 'trend_up' ELSE '' END AS reason, target_position FROM trend",
    "symbol day signal reason", "target_position", **TREND_VIEWS)

# Long-only rule: the state is the last event; the short variant needs the three-state walk.
MR = f"""SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS now,
 coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
 FROM (SELECT symbol, day, timestamp, price_zscore, CASE WHEN price_zscore <= -1.5 THEN 1.0 WHEN price_zscore >= -0.5 THEN 0.0 END AS ev FROM feats)"""
add("g02_mean_reversion", lambda s, d: g.mean_reversion(f.build_features(fx.bars(s, d), ema=False)),
    """SELECT symbol, day, now AS target_position, CASE WHEN bef = 0 AND now = 1 THEN 'oversold' WHEN bef = 1 AND now = 1 THEN 'long_hold'
    WHEN bef = 1 AND now = 0 THEN 'mean_revert_exit' ELSE '' END AS reason FROM mr""", "symbol day reason", "target_position", mr=MR, **q.VIEWS)
MRS_ROWS = "SELECT symbol, day, price_zscore AS zz, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM feats"
MRS = """/*RECURSIVE_MARK*/SELECT symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS target_position, '' AS reason FROM (SELECT DISTINCT symbol FROM mrs_rows)
 UNION ALL SELECT b.symbol, b.rn,
 CASE WHEN r.target_position = 0 AND zz <= -1.5 THEN 1.0 WHEN r.target_position = 0 AND zz >= 1.5 THEN -1.0 WHEN r.target_position > 0 AND zz >= -0.5 THEN 0.0
      WHEN r.target_position < 0 AND zz <= 0.5 THEN 0.0 ELSE r.target_position END,
 CASE WHEN r.target_position = 0 AND zz <= -1.5 THEN 'oversold' WHEN r.target_position = 0 AND zz >= 1.5 THEN 'overbought' WHEN r.target_position = 0 THEN ''
      WHEN (r.target_position > 0 AND zz >= -0.5) OR (r.target_position < 0 AND zz <= 0.5) THEN 'mean_revert_exit'
      WHEN r.target_position > 0 THEN 'long_hold' ELSE 'short_hold' END
 FROM mrs_rec r JOIN mrs_rows b ON b.symbol = r.symbol AND b.rn = r.rn + 1"""
add("g02_mean_reversion_short", lambda s, d: g.mean_reversion(f.build_features(fx.bars(s, d), ema=False), allow_short=True),
    "SELECT symbol, day, reason, target_position FROM mrs_rec JOIN mrs_rows USING (symbol, rn)", "symbol day reason", "target_position",
    mrs_rows=MRS_ROWS, mrs_rec=MRS, **q.VIEWS)

# Intraday bars: ticks cut to quarter hours, so a session has several bars.
INTRA = """SELECT symbol, time_bucket(INTERVAL 15 MINUTE, exchange_timestamp) AS timestamp, arg_min(ltp, row(exchange_timestamp, event_id)) AS open,
 max(ltp) AS high, min(ltp) AS low, arg_max(ltp, row(exchange_timestamp, event_id)) AS close, CAST(sum(last_traded_qty) AS BIGINT) AS volume FROM (SELECT * REPLACE (greatest(ltp, 0.01::DOUBLE) AS ltp) FROM ticks) GROUP BY 1, 2"""
ORB = """SELECT symbol, strftime(timestamp, '%Y-%m-%d %H:%M') AS minute, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol, sd ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS target_position,
 CASE WHEN ev = 1 THEN 'breakout_up' WHEN ev = -1 THEN 'breakout_down' ELSE '' END AS reason FROM (
 SELECT *, CASE WHEN n > 2 AND volume >= ov AND high >= oh * 1.0005::DOUBLE THEN 1.0 WHEN n > 2 AND volume >= ov AND low <= ol * 0.9995::DOUBLE THEN -1.0 END AS ev FROM (
 SELECT *, max(high) FILTER (n <= 2) OVER (PARTITION BY symbol, sd) AS oh, min(low) FILTER (n <= 2) OVER (PARTITION BY symbol, sd) AS ol,
  avg(volume) FILTER (n <= 2) OVER (PARTITION BY symbol, sd) AS ov FROM (
 SELECT *, CAST(timestamp + INTERVAL 330 MINUTE AS DATE) AS sd, row_number() OVER (PARTITION BY symbol, CAST(timestamp + INTERVAL 330 MINUTE AS DATE) ORDER BY timestamp) AS n FROM intraday)))"""


def intraday(s, d):
    from barlake.streaming.bars import resample_ticks

    return resample_ticks(fx.ticks(s, d).withColumn("ltp", F.greatest("ltp", F.lit(0.01))), "15m")


add("g03_opening_range_breakout",
    lambda s, d: g.opening_range_breakout(intraday(s, d), opening_bars=2, allow_short=True).withColumn("minute", F.date_format("timestamp", "yyyy-MM-dd HH:mm")),
    ORB, "symbol minute reason", "target_position", intraday=INTRA)


def latch_views(flags: str) -> dict[str, str]:
    """SQL latch: flags must give symbol, day, timestamp, close, atr, en, ex."""
    return {
        "latch_rows": f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM ({flags})",
        "latch_rec": """/*RECURSIVE_MARK*/SELECT symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS ep, '' AS reason FROM (SELECT DISTINCT symbol FROM latch_rows)
 UNION ALL SELECT b.symbol, b.rn,
 CASE WHEN r.pos > 0 AND atr > 0 AND r.ep > 0 AND close <= r.ep - 3 * atr THEN 0.0 WHEN r.pos = 0 AND en THEN 1.0 WHEN r.pos > 0 AND ex THEN 0.0 ELSE r.pos END,
 CASE WHEN r.pos > 0 AND atr > 0 AND r.ep > 0 AND close <= r.ep - 3 * atr THEN 0.0 WHEN r.pos = 0 AND en THEN close WHEN r.pos > 0 AND ex THEN 0.0 ELSE r.ep END,
 CASE WHEN r.pos > 0 AND atr > 0 AND r.ep > 0 AND close <= r.ep - 3 * atr THEN 'atr_stop_loss' WHEN r.pos = 0 AND en THEN 'ENTER' WHEN r.pos > 0 AND ex THEN 'LEAVE' ELSE '' END
 FROM latch_rec r JOIN latch_rows b ON b.symbol = r.symbol AND b.rn = r.rn + 1""",
    }


def latch_query(name: str, fn, enter: str, leave: str, en: str, ex: str, source: str = "feats", **views: str) -> None:
    flags = f"SELECT symbol, day, timestamp, close, atr, coalesce({en}, false) AS en, coalesce({ex}, false) AS ex FROM ({source})"
    sql = f"""SELECT symbol, day, replace(replace(r.reason, 'ENTER', '{enter}'), 'LEAVE', '{leave}') AS reason,
     CASE WHEN pos = 0 THEN 0.0 WHEN atr > 0 AND close > 0 THEN least(1.0, 0.02 * close / (3 * atr)) ELSE 1.0 END AS target_position
     FROM latch_rec r JOIN latch_rows USING (symbol, rn)"""
    add(name, lambda s, d: fn(fx.bars(s, d)), sql, "symbol day reason", "target_position", **{**q.VIEWS, **views, **latch_views(flags)})


def ret(n: int) -> str:
    return f"(close / nullif(lag(close, {n}) {W}, 0) - 1)"


def up200() -> str:
    return f"close > {full('avg(close)', 'close', 200)}"


latch_query("g04_time_series_momentum", g.time_series_momentum, "positive_time_series_momentum", "momentum_reversal",
            "r1 > 0 AND r2 > 0", "r1 <= 0", f"SELECT *, {ret(252)} AS r1, {ret(63)} AS r2 FROM feats")
latch_query("g05_donchian_trend", g.donchian_trend, "donchian_trend_entry", "donchian_trend_exit", "close > u", "close < l",
            f"SELECT *, {pfull('max(high)', 'high', 55)} AS u, {pfull('min(low)', 'low', 20)} AS l FROM feats")
latch_query("g06_rsi_pullback", g.rsi_pullback, "rsi_oversold_in_uptrend", "rsi_recovered", "x < 10 AND t", "x > 70",
            f"SELECT updown.*, atr, {q.rsi_sql(2).replace('ORDER BY timestamp', 'ORDER BY updown.timestamp').replace('PARTITION BY symbol', 'PARTITION BY updown.symbol')} AS x, "
            f"updown.close > avg(updown.close) OVER (PARTITION BY updown.symbol ORDER BY updown.timestamp ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AND "
            f"count(*) OVER (PARTITION BY updown.symbol ORDER BY updown.timestamp ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 AS t "
            f"FROM updown JOIN feats ON updown.symbol = feats.symbol AND updown.timestamp = feats.timestamp", **q.RSI)
latch_query("g07_bollinger_pullback", g.bollinger_pullback, "bollinger_pullback", "bollinger_mean_exit", "close < lo AND t", "close >= m",
            f"SELECT *, sma_medium AS m, sma_medium - 2 * {full('stddev_pop(close)', 'close', 20)} AS lo, {up200()} AS t FROM feats")
latch_query("g08_donchian_breakout", g.donchian_breakout, "donchian_breakout", "channel_failure", "close > u", "close < l",
            f"SELECT *, {pfull('max(high)', 'high', 20)} + 0.25 * lag(atr) {W} AS u, {pfull('min(low)', 'low', 10)} AS l FROM feats")
latch_query("g09_volume_confirmed_breakout", g.volume_confirmed_breakout, "volume_confirmed_breakout", "breakout_failure", "close > u AND volume > 1.5 * v", "close < m",
            f"SELECT *, {pfull('max(high)', 'high', 20)} AS u, {pfull('avg(volume)', 'volume', 20)} AS v, {pfull('avg(close)', 'close', 20)} AS m FROM feats")
latch_query("g10_volatility_contraction_breakout", g.volatility_contraction_breakout, "volatility_expansion_breakout", "volatility_breakout_failure",
            "recently_contracted AND close > u AND volume > 1.25 * v", "close < m",
            f"SELECT contract.*, atr, sma_medium AS m, max(contract.high) OVER p AS u, avg(contract.volume) OVER p AS v FROM contract "
            "JOIN feats ON contract.symbol = feats.symbol AND contract.timestamp = feats.timestamp "
            "WINDOW p AS (PARTITION BY contract.symbol ORDER BY contract.timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", **q.CONTRACTION)


def latch_plain(s, d):
    """The bare latch: entry and exit may both be true, no stop."""
    sr = f.bar_series(fx.bars(s, d), 5)
    sr = sr.with_columns({"_r": f.change(sr, "close", 1), "_m": f.sma(sr, 5)})
    return g.latch(sr.done(), F.col("_r") > 0.02, F.col("close") > F.col("_m"), "ENTER", "LEAVE", atr=None)


add("g20_latch", latch_plain,
    "SELECT symbol, day, r.reason, pos AS target_position FROM latch_rec r JOIN latch_rows USING (symbol, rn)", "symbol day reason", "target_position",
    **latch_views(f"SELECT symbol, day, timestamp, close, NULL::DOUBLE AS atr, coalesce({ret(1)} > 0.02, false) AS en, coalesce(close > {full('avg(close)', 'close', 5)}, false) AS ex FROM bars"))

# --- cross-section -----------------------------------------------------------------------
PBASE = f"""SELECT p.*, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS oc, {q.PIT.replace('b.', 'p.')} AS pit_eligible
 FROM panel_ret p"""


def panel(s, d):
    from barlake.operators.universe import mark_pit

    return mark_pit(q.panel(s, d), fx.constituents(s, d))


def rank_sql(score: str, name: str, lookback: int, top: float = 0.2, gross: float = 0.2, cap: int = 40) -> str:
    return f"""SELECT symbol, day, CASE WHEN rank <= sel THEN 'LONG' ELSE 'FLAT' END AS signal,
 CASE WHEN rank <= sel THEN '{name}_selected' ELSE '{name}_not_selected' END AS reason,
 CASE WHEN rank <= sel THEN {gross} / sel ELSE 0 END AS target_weight, score, rank FROM (
 SELECT *, least(greatest(1, ceil(n * {top}::DOUBLE)), {cap}) AS sel FROM (
 SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY timestamp) AS n FROM (
 SELECT * FROM (SELECT *, max(timestamp) OVER (PARTITION BY strftime(timestamp, '%Y-%m')) AS rebalance FROM ({score}) WHERE oc >= {lookback})
 WHERE timestamp = rebalance AND score IS NOT NULL AND isfinite(score) AND pit_eligible)))"""


def rank_query(query: str, name: str, score: str, digits: int | None = None, **views: str) -> None:
    lookback = g.CROSS_SECTIONAL[name][1]
    if digits is not None:
        score = f"SELECT * REPLACE (round(score, {digits}) AS score) FROM ({score})"
    add(query, lambda s, d: g.cross_sectional(name, panel(s, d), score_digits=digits), rank_sql(score, name, lookback), "symbol day signal reason", "target_weight score rank",
        **{"panel_ret": q.PANEL_RET, "pbase": PBASE, **views})


def fullp(expr: str, col: str, n: int) -> str:
    return full(expr, col, n)


ZD = "(({0} - avg({0}) OVER (PARTITION BY timestamp)) / nullif(stddev_samp({0}) OVER (PARTITION BY timestamp), 0))"
rank_query("g11_cross_sectional_momentum", "cross_sectional_momentum", f"SELECT *, lag(close, 21) {W} / nullif(lag(close, 252) {W}, 0) - 1 AS score FROM pbase")
rank_query("g12_fifty_two_week_high", "fifty_two_week_high",
           f"SELECT *, CASE WHEN {up200()} THEN close / ({pfull('max(high)', 'high', 252)}) END AS score FROM pbase")
MONTHS = "SELECT symbol, timestamp, close FROM (SELECT *, max(timestamp) OVER (PARTITION BY symbol, strftime(timestamp, '%Y-%m')) AS me FROM bars) WHERE timestamp = me"
STEPS = f"SELECT *, CAST(coalesce(close / nullif(lag(close) {W}, 0) - 1 > 0, false) AS INT) AS up, close / nullif(lag(close, 12) {W}, 0) - 1 AS y, row_number() {W} AS mn FROM months"
CONS = f"SELECT symbol, timestamp, CASE WHEN mn >= 12 AND sum(up) {rows(12)} >= 8 THEN y END AS score FROM steps"
rank_query("g13_consistent_momentum", "consistent_momentum", "SELECT pbase.*, score FROM pbase LEFT JOIN cons ON pbase.symbol = cons.symbol AND pbase.timestamp = cons.timestamp",
           months=MONTHS, steps=STEPS, cons=CONS)
rank_query("g14_residual_momentum", "residual_momentum",
           f"SELECT *, close / nullif(lag(close, 252) {W}, 0) - 1 - ({q.beta_sql(126)}) * (benchmark_close / nullif(lag(benchmark_close, 252) {W}, 0) - 1) AS score FROM pbase")
rank_query("g15_sector_relative_momentum", "sector_relative_momentum",
           f"SELECT *, 0.5 * own + 0.5 * avg(own) OVER (PARTITION BY timestamp, sector) AS score FROM (SELECT *, close / nullif(lag(close, 126) {W}, 0) - 1 AS own FROM pbase)")
rank_query("g16_short_term_reversal", "cross_sectional_short_term_reversal", f"SELECT *, CASE WHEN {up200()} THEN -(close / nullif(lag(close, 5) {W}, 0) - 1) END AS score FROM pbase")
VOL60 = full("stddev_pop(rs)", "rs", 60)
rank_query("g17_low_volatility", "low_volatility", f"SELECT *, CASE WHEN {up200()} THEN -({VOL60}) END AS score FROM pbase")
rank_query("g18_low_beta", "low_beta", f"SELECT *, -({q.beta_sql(252)}) AS score FROM pbase")
MOM = f"(close / nullif(lag(close, 252) {W}, 0) - close / nullif(lag(close, 21) {W}, 0))"
rank_query("g19a_momentum_reversal_volatility", "momentum_reversal_volatility",
           f"SELECT *, {ZD.format('a')} + {ZD.format('b')} - {ZD.format('c')} AS score FROM (SELECT *, {MOM} AS a, -(close / nullif(lag(close, 5) {W}, 0) - 1) AS b, {VOL60} AS c FROM pbase)", digits=9)
rank_query("g19b_ohlcv_multi_factor", "ohlcv_multi_factor",
           f"SELECT *, ({ZD.format('a')} + {ZD.format('t')} - {ZD.format('c')} + {ZD.format('l')}) / 4 AS score FROM (SELECT *, {MOM} AS a, close / ({full('avg(close)', 'close', 200)}) - 1 AS t, {VOL60} AS c, {full('avg(close * volume)', 'close', 20)} AS l FROM pbase)", digits=9)
add("g21_rank_and_weight",
    lambda s, d: g.rank_and_weight(panel(s, d).withColumn("score", F.col("close")), "price", 1, top=0.3, gross=0.5, max_holdings=3),
    rank_sql("SELECT *, close AS score FROM pbase", "price", 1, 0.3, 0.5, 3), "symbol day signal reason", "target_weight score rank",
    panel_ret=q.PANEL_RET, pbase=PBASE)

def logistic(s, d):
    from barlake.operators.learned import walk_forward_logistic

    return walk_forward_logistic(panel(s, d))


# No SQL twin: the model is fitted by iteration; tests compare it with a direct fit.
add("g19c_walk_forward_logistic", logistic, None, "symbol day signal reason", "target_weight score rank")

# --- sizing --------------------------------------------------------------------------------
SIG = f"SELECT *, greatest(-1, least(1, coalesce(close / nullif(lag(close, 5) {W}, 0) - 1, 0))) AS target_position FROM feats"
SIZED = {**q.VIEWS, "sig": SIG}


def sig(s, d):
    df = f.build_features(fx.bars(s, d), ema=False)
    r = f.n_period_return(df, [5])
    return g.signal_frame(r.withColumn("target_position", F.col("ret_5")))


add("g22_equal_weight", lambda s, d: g.equal_weight(sig(s, d)),
    "SELECT symbol, day, coalesce(target_position * 0.2 / nullif(sum(CAST(target_position <> 0 AS INT)) OVER (PARTITION BY timestamp), 0), 0) AS target_weight FROM sig",
    "symbol day", "target_weight", **SIZED)
add("g23_vol_target", lambda s, d: g.vol_target(sig(s, d)),
    """SELECT symbol, day, greatest(-0.2, least(0.2, target_position * 0.1 / coalesce(first_value(nullif(volatility, 0) IGNORE NULLS) OVER
    (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.1))) AS target_weight FROM sig""",
    "symbol day", "target_weight", **SIZED)
add("g24_cap_weights",
    lambda s, d: g.cap_weights(sig(s, d).withColumn("sector", F.when(F.col("sector") != "ASIA", F.col("sector")))),
    """SELECT symbol, day, w1 * CASE WHEN sum(w1) OVER t > 0.8 THEN 0.8 / sum(w1) OVER t ELSE 1 END AS capped_weight FROM (
    SELECT *, w0 * CASE WHEN sc <> 'UNKNOWN' AND sum(w0) OVER g > 0.25 THEN 0.25 / sum(w0) OVER g ELSE 1 END AS w1 FROM (
    SELECT symbol, day, timestamp, CASE WHEN sector = 'ASIA' THEN 'UNKNOWN' ELSE sector END AS sc, least(0.05, greatest(0, target_position)) AS w0 FROM sig)
    WINDOW g AS (PARTITION BY timestamp, sc)) WINDOW t AS (PARTITION BY timestamp)""", "symbol day", "capped_weight", **SIZED)
GRID = {"fast": (3, 5, 8), "slow": (20, 40)}
SETS_OF = [{"fast": fast, "slow": slow} for fast in GRID["fast"] for slow in GRID["slow"]]  # for the SQL
add("g25_parameter_sweep",
    lambda s, d: g.sma_cross_sweep(fx.bars(s, d), GRID).groupBy("param_id", "fast", "slow", "symbol").agg(F.sum("target_position").alias("days_long")),
    " UNION ALL ".join(
        f"SELECT {i} AS param_id, {c['fast']} AS fast, {c['slow']} AS slow, symbol, sum(CAST(coalesce(a > b, false) AS INT)) AS days_long FROM "
        f"(SELECT symbol, {full('avg(close)', 'close', c['fast'])} AS a, {full('avg(close)', 'close', c['slow'])} AS b FROM bars) GROUP BY symbol"
        for i, c in enumerate(SETS_OF)), "param_id fast slow symbol", "days_long")
