"""Metric, comparison, walk-forward and promotion queries, and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import evidence as e
from barlake.operators import execution as x
from barlake.operators import features as f
from barlake.operators import metrics as m
from barlake.operators import quality as q
from barlake.operators import signals as g
from barlake.operators import universe as u
from barlake.plans import fixtures as fx
from barlake.plans import q_execution as qx
from barlake.plans import q_quality as qq
from barlake.plans import q_signals as qs
from barlake.plans.q_quality import NUM
from barlake.functions.windows import INDEX
from barlake.plans.registry import add
from barlake.session import staged

RF = ("run_id", "fold_id")
METRIC_NAMES = ["total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "return_profit_factor"]


def metric_sql(source: str, keys: str, equity: str = "arg_max(equity, timestamp)") -> str:
    return f"""SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar FROM (
 SELECT {keys}, periods, fin / 100000 - 1 AS total_return, CASE WHEN periods > 1 AND fin > 0 THEN pow(fin / 100000, 252.0 / periods) - 1 ELSE 0 END AS cagr, sd * sqrt(252) AS volatility,
 CASE WHEN sd > 0 THEN mu / sd * sqrt(252) ELSE 0 END AS sharpe, CASE WHEN dn > 0 THEN mu / dn * sqrt(252) ELSE 0 END AS sortino, max_drawdown, CASE WHEN lo > 0 THEN ga / lo ELSE ga END AS return_profit_factor FROM (
 SELECT {keys}, count(*) AS periods, {equity} AS fin, avg(net_return) AS mu, stddev_pop(net_return) AS sd, stddev_pop(net_return) FILTER (net_return < 0) AS dn, min(drawdown) AS max_drawdown,
 sum(CASE WHEN net_return > 0 THEN net_return ELSE 0 END) AS ga, abs(sum(CASE WHEN net_return < 0 THEN net_return ELSE 0 END)) AS lo FROM {source} GROUP BY {keys}))"""


# --- flagship ----------------------------------------------------------------------------------
def trend_report(s, d):
    """Trend rule over every symbol: features, signals, vectorised back-test and metrics in one plan."""
    signals = g.trend_following(f.build_features(fx.bars(s, d), keep_index=True), min_volatility=0.01)
    signals = staged(signals.select("symbol", "timestamp", INDEX, "close", (F.col("target_position") * 0.5).alias("target_position")))
    curve = x.vector_backtest(signals, cost_bps=10.0)
    return m.metrics(curve, ("symbol",)).withColumn("final_log", F.log(F.col("final_equity") / 100_000)).orderBy(F.col("sharpe").desc())


HALF = "SELECT * REPLACE (target_position * 0.5 AS target_position) FROM trend"
REPORT = {**qs.TREND_VIEWS, "half": HALF, "bt": qx.BT.replace("SRC", "half"), "btn": qx.BTN, "bte": qx.BTE,
          "dd": f"SELECT *, exp(lg - greatest(lg, max(lg) {qx.W})) - 1 AS drawdown FROM bte"}
add("trend_rule_report", trend_report,
    f"SELECT symbol, periods, lgf AS final_log, volatility, sharpe, sortino, max_drawdown, turnover FROM ({metric_sql('dd', 'symbol', 'exp(max(lg)) * 0 + 100000')}) JOIN (SELECT symbol, arg_max(lg, timestamp) AS lgf, sum(turnover) AS turnover FROM dd GROUP BY 1) USING (symbol)",
    "symbol", "periods final_log volatility sharpe sortino max_drawdown turnover", digits=5, **REPORT)

# --- metrics -------------------------------------------------------------------------------------
add("m01_metrics", lambda s, d: m.metrics(fx.equity_curve(s, d)), metric_sql("curve", "run_id"), "run_id", "periods " + " ".join(METRIC_NAMES))
add("m01_fold_metrics", lambda s, d: m.metrics(fx.equity_curve(s, d), RF), metric_sql("curve", "run_id, fold_id"), "run_id fold_id", "periods " + " ".join(METRIC_NAMES))
add("m01_cost_metrics", lambda s, d: m.cost_metrics(fx.fills(s, d).withColumn("slippage_bps", F.lit(3.0))), "SELECT run_id, sum(fees) AS fees, 3 * count(*) AS slippage FROM fills GROUP BY 1", "run_id", "fees slippage", digits=4)
add("m02_var_cvar", lambda s, d: m.var_cvar(fx.equity_curve(s, d)),
    "SELECT run_id, max(v) AS var_95, avg(net_return) FILTER (net_return <= v) AS cvar_95 FROM curve JOIN (SELECT run_id, quantile_cont(net_return, 0.05) AS v FROM curve GROUP BY 1) USING (run_id) GROUP BY 1", "run_id", "var_95 cvar_95")
CDF = " ".join(f"WHEN u < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(m.poisson_steps()))
add("m03_bootstrap_sharpe", lambda s, d: m.bootstrap_sharpe(fx.equity_curve(s, d)),
    f"""SELECT run_id, CASE WHEN max(n) > 30 AND bool_or(varies) THEN coalesce(avg(CASE WHEN valid THEN CAST(s > 1e-12 AS DOUBLE) END), 0) ELSE 0 END AS monte_carlo_sharpe_prob FROM (
    SELECT run_id, rep, sum(w * net_return) AS s, count(*) AS n, max(net_return) > min(net_return) AS varies, max(net_return) FILTER (w > 0) > min(net_return) FILTER (w > 0) AS valid FROM (
    SELECT run_id, net_return, rep, CASE {CDF} ELSE {len(m.poisson_steps())} END AS w FROM (
    SELECT run_id, net_return, rep, CAST('0x' || substr(md5(run_id || '|' || epoch_us(timestamp) || '|' || rep), 1, {m.HEX_DIGITS}) AS BIGINT) / {16.0**m.HEX_DIGITS!r}::DOUBLE AS u FROM (
    SELECT run_id, net_return, timestamp, unnest(range(1000)) AS rep FROM curve))) GROUP BY 1, 2) GROUP BY 1""", "run_id", "monte_carlo_sharpe_prob")
add("m04_drawdown_duration", lambda s, d: m.drawdown_duration(fx.equity_curve(s, d)),
    """SELECT run_id, max(n) AS max_drawdown_duration FROM (SELECT run_id, isl, count(*) FILTER (drawdown < 0) AS n FROM (
    SELECT *, sum(CAST(drawdown >= 0 AS BIGINT)) OVER (PARTITION BY run_id ORDER BY timestamp) AS isl FROM curve) GROUP BY 1, 2) GROUP BY 1""", "run_id", "max_drawdown_duration")
add("m05_trade_stats", lambda s, d: m.trade_stats(qx.closings(s, d)),
    """SELECT run_id, count(*) AS trades, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, avg(pnl) AS average_trade, CASE WHEN sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END) < 0 THEN
    sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / abs(sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)) ELSE sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) END AS profit_factor FROM pnls GROUP BY 1""",
    "run_id", "trades win_rate average_trade profit_factor", digits=5, **qx.PV)


def long_metrics(s, d):
    """Run metrics in long form, with the trade columns a report needs."""
    return m.metrics_long(m.metrics(fx.equity_curve(s, d)), ["run_id"], METRIC_NAMES)


LONG = " UNION ALL ".join(f"SELECT run_id, '{n}' AS metric_name, {n} AS metric_value FROM rmet" for n in METRIC_NAMES)
ML = {"rmet": metric_sql("curve", "run_id"), "mlong": LONG}
add("m06_widen_metrics", lambda s, d: m.widen_metrics(long_metrics(s, d), ["total_return", "max_drawdown", "sharpe"]), "SELECT run_id, total_return, max_drawdown, sharpe FROM rmet", "run_id", "total_return max_drawdown sharpe", **ML)


def runs(s, d):
    """Eight runs of two strategies; odd ones carry an instrument in their id."""
    n = F.substring_index("run_id", "-", -1).cast("int")
    return fx.equity_curve(s, d).groupBy("run_id").agg(F.min("timestamp").alias("started_at")).select(
        "run_id", F.when(n % 2 == 0, "trend").otherwise("reversal").alias("strategy_name"), F.when(n % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("S"), (n % 3).cast("string"))).alias("symbol"), "started_at")


RN = "CAST(split_part(run_id, '-', 2) AS INT)"
RUNS = f"SELECT run_id, CASE WHEN {RN} % 2 = 0 THEN 'trend' ELSE 'reversal' END AS strategy_name, CASE WHEN {RN} % 3 <> 0 THEN 'S' || ({RN} % 3) END AS symbol, min(timestamp) AS started_at FROM curve GROUP BY run_id"
RV = {"rns": RUNS, **ML}
STOCK = "coalesce(nullif(split_part(r.run_id, ':', 2), ''), symbol, 'PORTFOLIO')"
add("m07_strategy_aggregate", lambda s, d: m.strategy_aggregate(runs(s, d), long_metrics(s, d)),
    f"""SELECT strategy_name, count(DISTINCT r.run_id) AS total_runs, count(DISTINCT {STOCK}) AS total_stocks, avg(total_return) AS avg_total_return, avg(sharpe) AS avg_sharpe, avg(max_drawdown) AS avg_max_drawdown
    FROM rns r JOIN rmet USING (run_id) GROUP BY 1""", "strategy_name", "total_runs total_stocks avg_total_return avg_sharpe avg_max_drawdown", **RV)
SOME = "SELECT * REPLACE (CASE WHEN run_id IN ('run-2', 'run-5') THEN 'unknown-' || run_id ELSE run_id END AS run_id) FROM round_trips"
BEST = f"""SELECT * FROM (SELECT r.*, {STOCK} AS instrument, coalesce(n, 0) > 0 AS has_trades, coalesce(pnl, 0) AS net_pnl, row_number() OVER (PARTITION BY strategy_name, {STOCK} ORDER BY CAST(coalesce(n, 0) > 0 AS INT) DESC, started_at DESC, r.run_id) AS rn
 FROM rns r LEFT JOIN (SELECT run_id, count(*) AS n, sum(net_pnl) AS pnl FROM some_trips GROUP BY 1) t ON t.run_id = r.run_id) JOIN rmet USING (run_id) WHERE rn = 1"""
BV = {**RV, "some_trips": SOME, "best": BEST}


def best(s, d):
    return m.best_run_per_symbol(runs(s, d), long_metrics(s, d), fx.round_trips(s, d).withColumn("run_id", F.expr("CASE WHEN run_id IN ('run-2', 'run-5') THEN 'unknown-' || run_id ELSE run_id END")))


add("m08_best_run_per_symbol", best, "SELECT strategy_name, instrument, run_id, has_trades, total_return, net_pnl FROM best", "strategy_name instrument run_id has_trades", "total_return net_pnl", digits=4, **BV)
add("m09_stock_performance", lambda s, d: m.stock_performance(fx.round_trips(s, d)),
    "SELECT run_id, symbol, sum(net_pnl) AS pnl, count(*) AS trade_count, avg(CAST(net_pnl > 0 AS DOUBLE)) AS win_rate FROM round_trips GROUP BY 1, 2", "run_id symbol", "pnl trade_count win_rate", digits=4)


def summary_sql(where: str) -> str:
    return f"""SELECT run_id, count(*) AS total_trades, sum(CAST(net_pnl > 0 AS BIGINT)) AS winning_trades, sum(CAST(net_pnl <= 0 AS BIGINT)) AS losing_trades, coalesce(avg(net_pnl) FILTER (net_pnl > 0), 0) AS avg_profit_per_win,
 coalesce(avg(net_pnl) FILTER (net_pnl <= 0), 0) AS avg_loss_per_loss, sum(net_pnl) AS total_pnl, coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / nullif(abs(coalesce(sum(net_pnl) FILTER (net_pnl < 0), 0)), 0) AS profit_factor,
 avg(CAST(net_pnl > 0 AS DOUBLE)) AS win_rate FROM round_trips WHERE {where} GROUP BY 1"""


SUMMARY = "total_trades winning_trades losing_trades avg_profit_per_win avg_loss_per_loss total_pnl profit_factor win_rate"
add("m10_trade_summary", lambda s, d: m.trade_summary(fx.round_trips(s, d)), summary_sql("true"), "run_id", SUMMARY, digits=4)
add("m10_trade_summary_scoped", lambda s, d: m.trade_summary(fx.round_trips(s, d), "NATION_20", 1998), summary_sql("symbol = 'NATION_20' AND year(exit_timestamp) = 1998"), "run_id", SUMMARY, digits=4)
MONTHLY = "SELECT run_id, year(timestamp) AS year, month(timestamp) AS month, arg_max(equity, timestamp) / arg_min(equity, timestamp) - 1 AS return_pct FROM curve GROUP BY 1, 2, 3"
add("m11_monthly_returns", lambda s, d: m.monthly_returns(fx.equity_curve(s, d)), "SELECT * FROM monthly", "run_id year month", "return_pct", monthly=MONTHLY)
add("m12_monthly_symbol_returns", lambda s, d: m.monthly_symbol_returns(fx.round_trips(s, d)),
    "SELECT run_id, symbol, year(exit_timestamp) AS year, month(exit_timestamp) AS month, sum(net_pnl) / 100000 AS return_pct FROM round_trips GROUP BY 1, 2, 3, 4", "run_id symbol year month", "return_pct")
add("m13_trade_ledger_view", lambda s, d: m.trade_ledger_view(fx.round_trips(s, d, numbered=True), "run-1"),
    "SELECT trade_id, symbol, gross_pnl, entry_cost + exit_cost AS fees, net_pnl, entry_reason, exit_reason FROM round_trips WHERE run_id = 'run-1'", "trade_id symbol entry_reason exit_reason", "gross_pnl fees net_pnl", digits=5)
add("m13_equity_curve_view", lambda s, d: m.equity_curve_view(fx.equity_curve(s, d), "run-3"), "SELECT day, equity, drawdown FROM curve WHERE run_id = 'run-3'", "day", "equity drawdown", digits=5)
add("m14_yearly_returns", lambda s, d: m.yearly_returns(m.monthly_returns(fx.equity_curve(s, d))).na.fill(0, ["year", "month"]),
    "SELECT run_id, coalesce(year, 0) AS year, coalesce(month, 0) AS month, sum(return_pct) AS return_pct, sum(return_pct) * 100000 AS total_pnl, count(*) AS months FROM monthly GROUP BY GROUPING SETS ((run_id, year, month), (run_id, year), (run_id))",
    "run_id year month", "return_pct total_pnl months", digits=5, monthly=MONTHLY)
add("m14_winners", lambda s, d: m.winners(best(s, d)),
    "SELECT strategy_name, count(*) FILTER (has_trades AND total_return > 0) AS profitable, count(*) FILTER (has_trades AND total_return < 0) AS losing, count(*) FILTER (has_trades) AS with_trades, avg(total_return) AS avg_return FROM best GROUP BY 1",
    "strategy_name", "profitable losing with_trades avg_return", **BV)
add("m15_run_listing", lambda s, d: m.run_listing(fx.promotion_reviews(s, d), "reviewed_at", 25, ("review_no",)).withColumn("day", F.date_format("reviewed_at", "yyyy-MM-dd")),
    "SELECT run_id, review_no, strftime(reviewed_at, '%Y-%m-%d') AS day, stage FROM reviews ORDER BY reviewed_at DESC, review_no LIMIT 25", "run_id review_no day stage")
add("m16_benchmark_relative", lambda s, d: m.benchmark_relative(fx.equity_curve(s, d), e.returns_of(fx.benchmark(s, d).withColumn("timestamp", F.date_trunc("day", "timestamp")))),
    """SELECT run_id, regr_slope(net_return, b) AS beta, (avg(net_return) - coalesce(regr_slope(net_return, b), 0) * avg(b)) * 252 AS alpha, CASE WHEN stddev_pop(net_return - b) > 0 THEN avg(net_return - b) / stddev_pop(net_return - b) * sqrt(252) ELSE 0 END AS information_ratio
    FROM curve JOIN (SELECT date_trunc('day', timestamp) AS t, benchmark_close / lag(benchmark_close) OVER (ORDER BY timestamp) - 1 AS b FROM benchmark_bars) ON t = curve.timestamp WHERE b IS NOT NULL GROUP BY 1""", "run_id", "beta alpha information_ratio")

# --- comparison ------------------------------------------------------------------------------------
PAIR = "SELECT a.run_id AS run_id_a, b.run_id AS run_id_b, a.timestamp, a.net_return AS x, b.net_return AS y, a.drawdown AS dx, b.drawdown AS dy, (a.net_return + b.net_return) / 2 AS mk FROM curve a JOIN curve b ON a.timestamp = b.timestamp AND a.run_id < b.run_id"
CORRS = "SELECT run_id_a, run_id_b, coalesce(corr(x, y), 0) AS return_correlation, count(*) AS points FROM pairs GROUP BY 1, 2"
CV = {"pairs": PAIR, "corrs": CORRS}


def evidence(s, d):
    """The curves that may be compared: a copy of run 1 with every return doubled is in-sample and must not count."""
    curve = fx.equity_curve(s, d)
    fitted = curve.where("run_id = 'run-1'").withColumns({"run_id": F.lit("run-9"), "net_return": 2 * F.col("net_return"), "evidence_level": F.lit("IN_SAMPLE")})
    return e.evidence_of(curve.unionByName(fitted))


def correlations(s, d):
    return e.return_correlation(evidence(s, d), tiles=3)


add("r01_close_pairs", lambda s, d: e.close_pairs(evidence(s, d), 0.03), "SELECT * FROM corrs WHERE abs(return_correlation) >= 0.03", "run_id_a run_id_b", "return_correlation points", pairs=PAIR, corrs=CORRS)


add("r01_return_correlation", correlations, "SELECT * FROM corrs", "run_id_a run_id_b", "return_correlation points", **CV)
EDGE = "SELECT run_id_a AS src, run_id_b AS dst FROM corrs WHERE abs(return_correlation) >= 0.03 UNION SELECT run_id_b, run_id_a FROM corrs WHERE abs(return_correlation) >= 0.03"
REACH = "/*RECURSIVE_MARK*/SELECT DISTINCT run_id, run_id AS other FROM curve UNION SELECT r.run_id, e.dst FROM reach r JOIN edges e ON e.src = r.other"
add("r02_clusters", lambda s, d: e.clusters(evidence(s, d), e.close_pairs(evidence(s, d), 0.03), 0.03), "SELECT run_id, min(other) AS cluster_id FROM reach GROUP BY 1", "run_id cluster_id", edges=EDGE, reach=REACH, **CV)
SETS = "SELECT DISTINCT run_id, month_, symbol, side FROM (SELECT *, strftime(timestamp, '%Y-%m') AS month_ FROM fills)"
add("r03_jaccard_overlap", lambda s, d: e.jaccard_overlap(fx.fills(s, d).withColumn("month", F.date_format("timestamp", "yyyy-MM")), ["month", "symbol", "side"], tiles=2),
    """SELECT a.run_id AS run_id_a, b.run_id AS run_id_b, count(*) / (max(na.n) + max(nb.n) - count(*)) AS overlap FROM sets a JOIN sets b ON a.month_ = b.month_ AND a.symbol = b.symbol AND a.side = b.side AND a.run_id < b.run_id
    JOIN (SELECT run_id, count(*) AS n FROM sets GROUP BY 1) na ON na.run_id = a.run_id JOIN (SELECT run_id, count(*) AS n FROM sets GROUP BY 1) nb ON nb.run_id = b.run_id GROUP BY 1, 2""", "run_id_a run_id_b", "overlap", sets=SETS)
add("r04_drawdown_overlap", lambda s, d: e.drawdown_overlap(evidence(s, d), tiles=2),
    """SELECT run_id_a, run_id_b, count(*) FILTER (x < 0 AND y < 0) / nullif(count(*) FILTER (x < 0 OR y < 0), 0) AS drawdown_overlap FROM (
    SELECT p.a AS run_id_a, p.b AS run_id_b, coalesce(ca.drawdown, 1) AS x, coalesce(cb.drawdown, 1) AS y FROM (SELECT a.run_id AS a, b.run_id AS b, t.timestamp FROM (SELECT DISTINCT run_id FROM curve) a JOIN (SELECT DISTINCT run_id FROM curve) b ON a.run_id < b.run_id CROSS JOIN (SELECT DISTINCT timestamp FROM curve) t) p
    LEFT JOIN curve ca ON ca.run_id = p.a AND ca.timestamp = p.timestamp LEFT JOIN curve cb ON cb.run_id = p.b AND cb.timestamp = p.timestamp) GROUP BY 1, 2""", "run_id_a run_id_b", "drawdown_overlap")
add("r05_regime_correlation", lambda s, d: e.regime_correlation(evidence(s, d), tiles=2),
    """SELECT run_id_a, run_id_b, coalesce(nullif(corr(x, y) FILTER (mk > 0), 'nan'::DOUBLE), 0) AS up, coalesce(nullif(corr(x, y) FILTER (mk < 0), 'nan'::DOUBLE), 0) AS down, coalesce(nullif(corr(x, y) FILTER (abs(mk) >= md), 'nan'::DOUBLE), 0) AS high_vol
    FROM pairs JOIN (SELECT run_id_a, run_id_b, quantile_cont(abs(mk), 0.5) AS md FROM pairs GROUP BY 1, 2) USING (run_id_a, run_id_b) GROUP BY 1, 2""", "run_id_a run_id_b", "up down high_vol", **CV)
add("r06_effective_bets", lambda s, d: e.effective_bets(evidence(s, d)),
    "SELECT n * n / (n + o) AS effective_bets FROM (SELECT count(DISTINCT run_id)::DOUBLE AS n FROM curve), (SELECT sum(2 * return_correlation * return_correlation) AS o FROM corrs)", "", "effective_bets", **CV)


def fold_metrics(s, d):
    wide = m.metrics(fx.equity_curve(s, d), RF).withColumns({"profit_factor": F.col("return_profit_factor"), "trades": F.col("periods")})
    return m.metrics_long(wide, RF, ["sharpe", "sortino", "calmar", "max_drawdown", "profit_factor", "trades"])


FM = {"fmet": metric_sql("curve", "run_id, fold_id")}
add("r07_strategy_summary", lambda s, d: e.strategy_summary(fold_metrics(s, d), fx.attribution(s, d)),
    """SELECT f.run_id, sharpe, sortino, calmar, max_drawdown, symbols_contributing, realized_pnl, cost FROM (SELECT run_id, avg(sharpe) AS sharpe, avg(sortino) AS sortino, avg(calmar) AS calmar, avg(max_drawdown) AS max_drawdown FROM fmet GROUP BY 1) f
    JOIN (SELECT run_id, count(DISTINCT symbol) AS symbols_contributing, sum(realized_pnl) AS realized_pnl, sum(cost) AS cost FROM attribution GROUP BY 1) a ON a.run_id = f.run_id""",
    "run_id", "sharpe sortino calmar max_drawdown symbols_contributing realized_pnl cost", digits=4, **FM)
add("r08_explain_loss", lambda s, d: e.explain_loss(fx.attribution(s, d), "run-2"),
    "SELECT run_id, symbol, reason, exit_classification, sum(realized_pnl) AS pnl, sum(gross_pnl) AS gross_pnl, sum(cost) AS cost, sum(quantity) AS quantity, avg(holding_period_days) AS average_holding_days, count(*) AS events FROM attribution WHERE run_id = 'run-2' GROUP BY 1, 2, 3, 4",
    "run_id symbol reason exit_classification", "pnl gross_pnl cost quantity average_holding_days events", digits=4)
add("r08_loss_by_sector", lambda s, d: e.loss_by_sector(fx.attribution(s, d), fx.bars(s, d).select("symbol", F.nullif("sector", F.lit("ASIA")).alias("sector")).distinct()),
    "SELECT run_id, CASE WHEN sector = 'ASIA' THEN 'UNKNOWN' ELSE sector END AS sector, sum(realized_pnl) AS pnl, sum(cost) AS cost FROM attribution GROUP BY 1, 2", "run_id sector", "pnl cost", digits=4)
add("r08_loss_groupings", lambda s, d: e.loss_groupings(fx.attribution(s, d)),
    "SELECT run_id, reason, symbol, sum(realized_pnl) AS pnl, sum(cost) AS cost FROM attribution GROUP BY GROUPING SETS ((run_id), (run_id, reason), (run_id, symbol))", "run_id reason symbol", "pnl cost", digits=4)
add("r08_worst_round_trips", lambda s, d: e.worst_round_trips(fx.round_trips(s, d, numbered=True), "run-2", 20),
    "SELECT trade_id, symbol, net_pnl FROM round_trips WHERE run_id = 'run-2' ORDER BY net_pnl, exit_timestamp, trade_id LIMIT 20", "trade_id symbol", "net_pnl")

# --- walk-forward ------------------------------------------------------------------------------------
NDATES = "SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS n FROM (SELECT DISTINCT timestamp FROM bars)"
FOLDED = "SELECT timestamp, k, printf('wf-%03d', k + 1) AS fold_id FROM (SELECT *, (n - 253) // 63 AS k, count(*) OVER (PARTITION BY (n - 253) // 63) AS c FROM ndates WHERE n >= 253) WHERE c = 63"
FOLDS = """SELECT fold_id, k, min(timestamp) AS test_start, max(timestamp) AS test_end, 253 + k * 63 AS train_size, (SELECT min(timestamp) FROM bars) AS train_start, (SELECT timestamp FROM ndates WHERE n = 253 + k * 63 - 1) AS train_end FROM folded GROUP BY 1, 2"""
WV = {"ndates": NDATES, "folded": FOLDED, "folds": FOLDS}
YMD = "yyyy-MM-dd"


def folds(s, d):
    return e.walk_forward_folds(fx.bars(s, d), 252, 63, lookback=253)


add("wf1_walk_forward_folds", lambda s, d: folds(s, d).select("fold_id", "train_size", *[F.date_format(c, YMD).alias(c[:5] + c[5:7]) for c in ("train_start", "train_end", "test_start", "test_end")]),
    "SELECT fold_id, train_size, " + ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c[:7]}" for c in ("train_start", "train_end", "test_start", "test_end")) + " FROM folds",
    "fold_id train_s train_e test_st test_en", "train_size", **WV)
GRID = {"fast": (3, 5), "slow": (20, 40)}
SETS_OF = [{"fast": fast, "slow": slow} for fast in GRID["fast"] for slow in GRID["slow"]]  # for the SQL


def candidate_curve(s, d):
    """All candidates back-tested at once; ``fold`` numbers the calendar years."""
    swept = g.sma_cross_sweep(fx.bars(s, d), GRID).withColumn("target_position", F.col("target_position") * 0.5)
    swept = staged(swept.select("symbol", "timestamp", "close", "param_id", "fast", "slow", "target_position"))
    curve = x.vector_backtest(swept, keys=("param_id", "symbol"))
    text = F.format_string('{"fast":%d,"slow":%d}', "fast", "slow")
    return curve.withColumns({"fold": F.year("timestamp") - 1994, "parameters_json": text})


def fold_scores(curve):
    scored = m.metrics(curve.withColumn("fold_id", F.concat(F.lit("wf-"), "fold")), ("fold_id", "symbol", "parameters_json"))
    return scored.withColumns({"sharpe": F.round("sharpe", 9), "max_drawdown": F.round("max_drawdown", 9)})


def walk_forward(s, d):
    """Train on all years before a fold's year, select, score the selected candidate on that year."""
    curve = staged(candidate_curve(s, d))
    last = curve.agg(F.max("fold")).first()[0] or 0
    before = curve.filter(F.col("fold") < last).withColumn("fold", F.explode(F.sequence(F.col("fold") + 1, F.lit(last))))
    return e.walk_forward_select(fold_scores(before), fold_scores(curve), ("fold_id", "symbol"))


SWEEP = " UNION ALL ".join(
    f"SELECT symbol, timestamp, day, close, {i} AS pid, '{{\"fast\":{c['fast']},\"slow\":{c['slow']}}}' AS parameters_json, CASE WHEN coalesce({qs.full('avg(close)', 'close', c['fast'])} > {qs.full('avg(close)', 'close', c['slow'])}, false) THEN 0.5 ELSE 0 END::DOUBLE AS target_position FROM bars"
    for i, c in enumerate(SETS_OF))
WP = "OVER (PARTITION BY pid, symbol ORDER BY timestamp)"
CAND = f"""SELECT *, exp(lg - greatest(lg, max(lg) {WP})) - 1 AS drawdown, exp(lg) * 100000 AS equity, year(timestamp) - 1994 AS fold FROM (SELECT *, sum(ln(1 + net_return)) {WP} AS lg FROM (
 SELECT *, coalesce(lag(target_position) {WP}, 0) * coalesce(close / lag(close) {WP} - 1, 0) AS net_return FROM sweep))"""
TRAINED = f"SELECT c.* EXCLUDE (fold), 'wf-' || n.fold AS fold_id FROM cand c JOIN (SELECT DISTINCT fold FROM cand) n ON c.fold < n.fold"
SCORED = metric_sql("(SELECT *, 'wf-' || fold AS fold_id FROM cand)", "fold_id, symbol, parameters_json")
PICK = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, symbol ORDER BY round(sharpe, 9) DESC, round(max_drawdown, 9) DESC, parameters_json DESC) AS rn FROM ({metric_sql('trained', 'fold_id, symbol, parameters_json')})) WHERE rn = 1"
add("wf2_select_parameters", walk_forward,
    "SELECT fold_id, symbol, parameters_json, p.sharpe AS training_score, t.sharpe AS test_score FROM pick p JOIN scored t USING (fold_id, symbol, parameters_json)", "fold_id symbol parameters_json",
    "training_score test_score", sweep=SWEEP, cand=CAND, trained=TRAINED, scored=SCORED, pick=PICK)
TESTED = "SELECT c.run_id, c.timestamp, c.day, c.net_return, f.fold_id FROM curve c JOIN folded f ON date_trunc('day', f.timestamp) = c.timestamp"
WO = "OVER (PARTITION BY run_id, fold_id ORDER BY timestamp)"
add("wf3_oos_curve",
    lambda s, d: e.oos_curve(fx.equity_curve(s, d), e.fold_dates(fx.bars(s, d), 252, 63, 253).withColumn("timestamp", F.date_trunc("day", "timestamp"))),
    f"SELECT run_id, fold_id, day, 100000 * exp(lg) AS equity, exp(lg - max(lg) {WO}) - 1 AS drawdown FROM (SELECT *, sum(ln(1 + net_return)) {WO} AS lg FROM tested)", "run_id fold_id day", "equity drawdown", digits=4, tested=TESTED, **WV)


add("wf4_fold_slice", lambda s, d: e.fold_slice(fx.round_trips(s, d, numbered=True), folds(s, d), "exit_timestamp"),
    "SELECT trade_id, f.fold_id FROM round_trips r JOIN folds f ON r.exit_timestamp BETWEEN f.test_start AND f.test_end", "trade_id fold_id", **WV)
add("wf5_content_key", lambda s, d: e.content_key(fx.table(s, d, "part"), ["p_name", "p_brand", "p_size"]),
    """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS content_key FROM part""", "p_partkey content_key")
STRATEGIES = [("donchian_trend", "SINGLE_ASSET"), ("low_beta", "CROSS_SECTIONAL"), ("rsi_pullback", "SINGLE_ASSET")]
PARAMS = {"donchian_trend": ['{"n":20}', '{"n":55}']}
NODONE = "job_key string"


def jobs(s, d):
    symbols = fx.bars(s, d).select("symbol").distinct()
    cover = u.coverage(fx.bars(s, d)).select("symbol", "bars")
    every = e.job_matrix(symbols, STRATEGIES, PARAMS, s.createDataFrame([], NODONE), cover, "snap")
    done = every.filter("symbol LIKE '%2' AND strategy_name = 'rsi_pullback'").select("job_key")
    return e.job_matrix(symbols, STRATEGIES, PARAMS, done, cover, "snap")


add("wf6_job_matrix", jobs,
    """SELECT symbol, strategy_name, strategy_scope, parameters_json, bars FROM (SELECT symbol, count(*) AS bars FROM bars GROUP BY 1), (VALUES ('donchian_trend', 'SINGLE_ASSET', '{"n":20}'), ('donchian_trend', 'SINGLE_ASSET', '{"n":55}'), ('rsi_pullback', 'SINGLE_ASSET', '{}')) v(strategy_name, strategy_scope, parameters_json)
    WHERE NOT (symbol LIKE '%2' AND strategy_name = 'rsi_pullback') UNION ALL SELECT '*', 'low_beta', 'CROSS_SECTIONAL', '{}', NULL FROM (SELECT 1)""", "symbol strategy_name strategy_scope parameters_json", "bars")

# --- promotion ----------------------------------------------------------------------------------------
CHOSEN = "SELECT run_id, fold_id, CASE WHEN count(*) % 3 = 0 THEN '{\"a\":1}' ELSE '{\"a\":2}' END AS parameters_json FROM curve GROUP BY 1, 2"


def chosen(s, d):
    n = fx.equity_curve(s, d).groupBy("run_id", "fold_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("parameters_json", F.when(F.col("n") % 3 == 0, '{"a":1}').otherwise('{"a":2}'))


STABLE = "SELECT run_id, max(c) / sum(c) AS parameter_stability FROM (SELECT run_id, parameters_json, count(*) AS c FROM chosen GROUP BY 1, 2) GROUP BY 1"
STRESS = """SELECT run_id, sum(b - a - coalesce(c, 0)) AS stressed_pnl FROM (SELECT run_id, fold_id, arg_min(equity / nullif(1 + net_return, 0), timestamp) AS a, arg_max(equity, timestamp) AS b FROM curve GROUP BY 1, 2)
 LEFT JOIN (SELECT run_id, fold_id, sum(cost) AS c FROM attribution GROUP BY 1, 2) USING (run_id, fold_id) GROUP BY 1"""
BREADTH = "SELECT a.run_id, coalesce(contributors, 0) AS contributors, coalesce(top_share, 1) AS top_share, coalesce(contributors, 0) >= 5 AND coalesce(top_share, 1) <= 0.5 AS profit_breadth FROM (SELECT DISTINCT run_id FROM attribution) a LEFT JOIN (SELECT run_id, count(*) AS contributors, max(p) / sum(p) AS top_share FROM (SELECT run_id, symbol, sum(realized_pnl) AS p FROM attribution GROUP BY 1, 2 HAVING sum(realized_pnl) > 0) GROUP BY 1) b ON b.run_id = a.run_id"
PROMOTED = "SELECT * FROM (SELECT run_id, arg_max(stage, row(reviewed_at, review_no)) AS stage, arg_max(decision, row(reviewed_at, review_no)) AS decision, arg_max(human_approved, row(reviewed_at, review_no)) AS human_approved FROM reviews GROUP BY 1) WHERE stage IN ('PAPER_CANDIDATE', 'PAPER_ACTIVE') AND decision = 'PASS' AND human_approved"
MAXC = "SELECT run_id, max(c) AS maximum_correlation FROM (SELECT run_id_a AS run_id, run_id_b AS o, abs(return_correlation) AS c FROM corrs UNION ALL SELECT run_id_b, run_id_a, abs(return_correlation) FROM corrs) WHERE o IN (SELECT run_id FROM promoted) GROUP BY 1"
PV = {"chosen": CHOSEN, "stable": STABLE, "stress": STRESS, "breadth": BREADTH, "promoted": PROMOTED, "maxc": MAXC, **CV}
add("p2_parameter_stability", lambda s, d: e.parameter_stability(chosen(s, d)), "SELECT * FROM stable", "run_id", "parameter_stability", **PV)
add("p3_cost_stress", lambda s, d: e.cost_stress(fx.equity_curve(s, d), fx.attribution(s, d)), "SELECT *, stressed_pnl > 0 AS cost_stress FROM stress", "run_id cost_stress", "stressed_pnl", digits=4, **PV)
add("p4_profit_breadth", lambda s, d: e.profit_breadth(fx.attribution(s, d)), "SELECT * FROM breadth", "run_id profit_breadth", "contributors top_share", **PV)


def promoted(s, d):
    return e.latest_promoted(fx.promotion_reviews(s, d), ("reviewed_at", "review_no"))


add("p5_latest_promoted", promoted, "SELECT run_id, stage FROM promoted", "run_id stage", **PV)
add("p6_max_correlation_to_promoted", lambda s, d: e.max_correlation_to_promoted(evidence(s, d), promoted(s, d)), "SELECT * FROM maxc", "run_id", "maximum_correlation", **PV)


def cert_runs(s, d):
    n = F.substring_index("run_id", "-", -1).cast("int")
    return fx.promotion_reviews(s, d).select("run_id").distinct().select(
        "run_id", F.when(n % 3 == 0, "all").when(n % 3 == 1, "other").alias("universe_name"), F.when(n == 4, "DEBUG").otherwise("BACKTEST").alias("mode"), F.lit("h").alias("data_hash"), F.when(n == 5, "g").otherwise("h").alias("frame_hash"))


def cert_inputs(s, d):
    ds = qq.datasets(s, d)
    links = fx.round_trips(s, d).select("run_id", "symbol").distinct()
    used = links.select(F.expr("concat('run-', substring_index(symbol, '_', -1) % 8)").alias("run_id"), F.concat(F.lit("ds-"), F.col("symbol")).alias("dataset_id")).distinct()
    after = F.when(F.col("run_id") == "run-6", F.lit("2100-01-01").cast("timestamp")).otherwise(F.col("timestamp"))
    late = fx.fills(s, d).select("run_id", "order_id", after.alias("timestamp"))
    curves = fx.equity_curve(s, d).withColumn("run_id", F.expr("CASE run_id WHEN 'run-2' THEN 'run-102' WHEN 'run-4' THEN 'run-104' ELSE run_id END"))
    orders = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("requested_at"))
    return cert_runs(s, d), used, ds, qq.certificates(s, d), qq.child_checks(s, d), late, orders, fx.constituents(s, d), curves, q.REQUIRED_CHECKS


USED = f"SELECT DISTINCT 'run-' || ({NUM} % 8) AS run_id, 'ds-' || symbol AS dataset_id, symbol FROM round_trips"
OKDS = f"""SELECT ds.symbol, ds.dataset_id, ds.status = 'VERIFIED' AND lifecycle_status = 'CANONICAL_PROMOTED' AS ver, ds.status = 'VERIFIED' AND lifecycle_status = 'CANONICAL_PROMOTED' AND {NUM.replace('symbol', 'ds.symbol')} % 8 <> 7 AND c.st = 'CERTIFIED' AND {NUM.replace('symbol', 'ds.symbol')} % 6 <> 3 AS ok
 FROM ds JOIN (SELECT m.symbol, CASE WHEN sum(issue_count) = 0 AND max(critical_count + error_count) = 0 THEN 'CERTIFIED' ELSE 'FAILED' END AS st FROM mixed_report m JOIN severe USING (symbol) WHERE check_type IN ({qq.REQ}) GROUP BY 1) c ON c.symbol = ds.symbol"""
CERT = f"""SELECT run_id, unnest([{', '.join(repr(c) for c in e.CATEGORIES)}]) AS category, unnest([CASE WHEN {RN} = 5 OR nds IS NULL OR NOT allver THEN 'FAIL' ELSE 'PASS' END, CASE WHEN nds IS NULL OR NOT allok THEN 'FAIL' ELSE 'PASS' END,
 CASE WHEN {RN} <> 6 AND early > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN {RN} % 3 = 1 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN {RN} = 2 THEN 'FAIL' ELSE 'PASS' END]) AS status
 FROM (SELECT DISTINCT run_id FROM reviews) r LEFT JOIN (SELECT run_id, count(*) AS nds, bool_and(ver) AS allver, bool_and(ok) AS allok FROM used JOIN okds USING (dataset_id) GROUP BY 1) u USING (run_id)
 LEFT JOIN (SELECT run_id, count(*) FILTER (timestamp < requested_at) AS early FROM fills GROUP BY 1) f USING (run_id)"""
CERTV = {"used": USED, "okds": OKDS, "cert": CERT, "ds": qq.DS, "mixed_report": qq.MIXED, "severe": qq.SEVERE, **qq.RV}
add("p7_certify_runs", lambda s, d: e.certify_runs(*cert_inputs(s, d)), "SELECT * FROM cert", "run_id category status", **CERTV)


def simple_certs(s, d):
    """Categories failing by run number, so that the gates see both outcomes."""
    n = F.substring_index("run_id", "-", -1).cast("int")
    base = fx.equity_curve(s, d).select("run_id").distinct()
    return base.select("run_id", F.posexplode(F.array(*[F.lit(c) for c in e.CATEGORIES])).alias("p", "category")).withColumn("status", F.when(n == F.col("p") + 3, "FAIL").otherwise("PASS"))


POLICY = e.PromotionPolicy(minimum_sharpe=-0.3, minimum_sortino=-0.3, minimum_profit_factor=0.95, maximum_drawdown=0.6, maximum_cluster_correlation=0.02)


def gates(s, d):
    n = F.substring_index("run_id", "-", -1).cast("int")
    rs = fx.equity_curve(s, d).select("run_id").distinct().withColumns({"is_portfolio": n % 2 == 0, "human_approved": n % 3 == 0, "paper_activation": n % 4 == 0})
    return e.promotion_gates(rs, fold_metrics(s, d), fx.equity_curve(s, d), simple_certs(s, d), e.parameter_stability(chosen(s, d)), e.cost_stress(fx.equity_curve(s, d), fx.attribution(s, d)),
                             e.profit_breadth(fx.attribution(s, d)), promoted(s, d), e.max_correlation_to_promoted(evidence(s, d), promoted(s, d)), POLICY)


GATES = [("sharpe", "sharpe >= -0.3"), ("sortino", "sortino >= -0.3"), ("profit_factor", "pf >= 0.95"), ("drawdown", "abs(max_drawdown) <= 0.6"), ("trades", "trades >= 20"), ("out_of_sample", f"{RN} <> 7"), ("minimum_folds", "folds_n >= 3"),
         ("fold_consistency", "positive >= 0.6"), ("cost_stress", "stressed_pnl > 0"), ("parameter_stability", "parameter_stability >= 0.5"), ("profit_breadth", f"{RN} % 2 = 1 OR profit_breadth"), ("zero_survivorship_bias", f"{RN} <> 6"),
         ("data_quality_verified", f"{RN} <> 4"), ("causality_certified", f"{RN} <> 5"), ("data_lineage_verified", f"{RN} <> 3"), ("correlation_evidence", "alone OR maximum_correlation IS NOT NULL"),
         ("independent", "alone OR (maximum_correlation IS NOT NULL AND maximum_correlation < 0.02)")]
FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({t}, false) THEN '{n}' END" for n, t in GATES) + ")"
add("p1_promotion_gates", lambda s, d: gates(s, d).withColumn("reasons", F.array_join("reasons", ",")),
    f"""SELECT run_id, reasons, CASE WHEN reasons = '' THEN 1.0 ELSE 1 - len(string_split(reasons, ',')) / 18.0 END AS score, CASE WHEN reasons = '' THEN 'PASS' ELSE 'REJECT' END AS decision,
    CASE WHEN reasons <> '' THEN 'RESEARCH_ONLY' WHEN {RN} % 3 = 0 AND {RN} % 4 = 0 THEN 'PAPER_ACTIVE' WHEN {RN} % 3 = 0 THEN 'PAPER_CANDIDATE' ELSE 'BACKTEST_VALIDATED' END AS stage FROM (
    SELECT run_id, {FAILED} AS reasons FROM (SELECT f.*, stressed_pnl, parameter_stability, profit_breadth, maximum_correlation, (SELECT count(*) FROM promoted p WHERE p.run_id <> f.run_id) = 0 AS alone FROM (
    SELECT run_id, avg(sharpe) AS sharpe, avg(sortino) AS sortino, avg(return_profit_factor) AS pf, avg(max_drawdown) AS max_drawdown, avg(periods) AS trades, count(*) AS folds_n, avg(CAST(sharpe > 0 AS DOUBLE)) AS positive FROM fmet GROUP BY 1) f
    LEFT JOIN stress USING (run_id) LEFT JOIN stable USING (run_id) LEFT JOIN breadth USING (run_id) LEFT JOIN maxc USING (run_id)))""", "run_id reasons decision stage", "score", **FM, **PV)
add("p8_dataset_group",
    lambda s, d: e.dataset_group(fx.bars(s, d).withColumn("dataset_id", F.concat(F.lit("ds-"), F.col("symbol"))), fx.table(s, d, "nation").filter("n_nationkey > 12").select(F.col("n_name").alias("symbol"), F.lit("MISSING_DATA").alias("reason")),
                                  fx.table(s, d, "nation").select(F.col("n_name").alias("symbol")), "snap", "1d", "0123456789abcdef0000"),
    """SELECT n_name AS symbol, CASE WHEN n_name IN (SELECT symbol FROM bars) THEN 'ds-' || n_name END AS dataset_id, CASE WHEN n_nationkey > 12 THEN 'MISSING_DATA' END AS exclusion_reason, 'snap:1d:0123456789abcdef' AS group_id FROM nation""",
    "symbol dataset_id exclusion_reason group_id")
