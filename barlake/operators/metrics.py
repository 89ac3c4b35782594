"""Performance metrics of equity curves and trades, and the report queries over them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import Running, cols, scan, value_chunk
from barlake.operators.calendar import annualization_factor

RUN = ("run_id",)


def metrics(curve: DataFrame, keys: Sequence[str] = RUN, timeframe: str = "1d", capital: float = 100_000.0) -> DataFrame:
    """Return, risk and ratio columns per run (and fold): one partial aggregation."""
    factor = annualization_factor(timeframe)
    r = F.col("net_return")
    wide = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.max_by("equity", "timestamp").alias("final_equity"), F.avg(r).alias("_mean"),
        F.stddev_pop(r).alias("_std"), F.stddev_pop(F.when(r < 0, r)).alias("_down"), F.min("drawdown").alias("max_drawdown"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gain"), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0))).alias("_loss"),
        (F.sum("turnover") if "turnover" in curve.columns else F.lit(None).cast("double")).alias("turnover"),
        (F.avg(F.abs("position")) if "position" in curve.columns else F.lit(None).cast("double")).alias("exposure"),
    )
    final, n = F.col("final_equity"), F.col("periods")
    ratio = lambda dev: F.when(dev > 0, F.col("_mean") / dev * F.lit(factor**0.5)).otherwise(0.0)
    cagr = F.when((n > 1) & (final > 0), F.pow(final / capital, F.lit(factor) / n) - 1).otherwise(0.0)
    out = wide.withColumns({
        "total_return": final / capital - 1, "cagr": cagr, "volatility": F.col("_std") * F.lit(factor**0.5),
        "sharpe": ratio(F.col("_std")), "sortino": ratio(F.coalesce("_down", F.lit(0.0))),
        "return_profit_factor": F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).otherwise(F.col("_gain")),
    })
    calmar = F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0)
    return out.withColumn("calmar", calmar).drop("_mean", "_std", "_down", "_gain", "_loss")


def cost_metrics(fills: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    slip = F.sum("slippage_bps") if "slippage_bps" in fills.columns else F.lit(0.0)
    return fills.groupBy(*keys).agg(F.sum("fees").alias("fees"), slip.alias("slippage"))


def metrics_long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    typed = wide.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot(list(keys), list(names), "metric_name", "metric_value")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, per_unit: int = 256) -> DataFrame:
    """(keys, value, _n, _upto): each distinct value of a key, its rows, and the rows at or below it.

    Equal values are counted before the shuffle, so a value that a third of the rows share is one row; distinct values
    are ranked through monotone value buckets, so no key's values are gathered in one buffer.
    """
    present = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return scan(present, keys, (value,), [Running("_upto", "sum", F.col("_n"))], chunk=value_chunk(F.col(value), per_unit))


def at_rank(value: str, rank: Column) -> Column:
    """The value whose rows cover a 0-based rank; NULL on the rows of other values."""
    return F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col(value))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, per_unit: int = 25_600) -> DataFrame:
    """Exact linear-interpolated quantile per key, by weighted selection over distinct values and their counts."""
    ranked = value_ranks(df, keys, value, per_unit)
    sizes = ranked.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    placed = ranked.join(sizes, list(keys)).withColumn("_spot", (F.col("_size") - 1) * F.lit(q))
    picked = placed.groupBy(*keys).agg(
        F.max(at_rank(value, F.floor("_spot"))).alias("_lo"), F.max(at_rank(value, F.ceil("_spot"))).alias("_hi"),
        F.first(F.col("_spot") - F.floor("_spot")).alias("_w"))
    return picked.select(*keys, (F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo"))).alias(name))


def var_cvar(curve: DataFrame, keys: Sequence[str] = RUN, level: float = 0.05) -> DataFrame:
    """5 % quantile of returns and the mean of the returns at or below it."""
    var = exact_quantile(curve, keys, "net_return", level, "var_95")
    tail = curve.join(var, list(keys)).groupBy(*keys).agg(
        F.max("var_95").alias("var_95"), F.avg(F.when(F.col("net_return") <= F.col("var_95"), F.col("net_return"))).alias("cvar_95"))
    return tail.withColumn("cvar_95", F.coalesce("cvar_95", "var_95"))


HEX_DIGITS = 13


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities, as far as a uniform draw of 52 bits can tell them apart."""
    term, total, steps = math.exp(-1.0), 0.0, []
    while 1.0 - total > 16.0**-HEX_DIGITS:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def bootstrap_draw(name: Column, rep: Column) -> Column:
    """A uniform draw for a row and a resample from the MD5 of both, the same on every retry."""
    digest = F.md5(F.concat_ws("|", name, rep.cast("string")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(16.0**HEX_DIGITS)


def bootstrap_weight(draw: Column) -> Column:
    """How often a row enters a resample: Poisson(1) by inversion; ``draw`` should be a plain column, as it is read often."""
    weight = F.lit(len(poisson_steps()))
    for k, step in reversed([*enumerate(poisson_steps())]):
        weight = F.when(draw < step, k).otherwise(weight)
    return weight


def bootstrap_sharpe(curve: DataFrame, keys: Sequence[str] = RUN, reps: int = 1000, minimum: int = 30) -> DataFrame:
    """Share of resamples with a positive Sharpe ratio, for runs longer than ``minimum`` whose returns vary.

    Resamples without deviation don't count.  Rows are expanded in the map stage and summed per
    resample before the shuffle, so ``reps`` sums per run and task are what moves.
    """
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.unix_micros("timestamp").cast("string"))
    base = curve.select(*keys, name.alias("_name"), "net_return")
    drawn = base.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    # exploded, so that the optimiser keeps the draw as a column of its own
    drawn = drawn.withColumn("_u", F.explode(F.array(bootstrap_draw(F.col("_name"), F.col("_rep"))))).withColumn("_w", F.explode(F.array(bootstrap_weight(F.col("_u")))))
    r, w = F.col("net_return"), F.col("_w")
    inside = lambda f: f(F.when(w > 0, r))
    sums = drawn.groupBy(*keys, "_rep").agg(
        F.sum(w * r).alias("_s"), F.count(F.lit(1)).alias("_n"), (F.max(r) > F.min(r)).alias("_varies"), (inside(F.max) > inside(F.min)).alias("_valid"))
    share = F.avg(F.when(F.col("_valid"), (F.col("_s") > 1e-12).cast("double")))
    return sums.groupBy(*keys).agg(F.when((F.max("_n") > minimum) & F.bool_or("_varies"), F.coalesce(share, F.lit(0.0))).otherwise(0.0).alias("monte_carlo_sharpe_prob"))


def drawdown_duration(curve: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Longest unbroken stretch of bars under water: islands between non-negative rows."""
    marked = scan(curve.select(*keys, "timestamp", "drawdown"), keys, ("timestamp",), [Running("_island", "count", F.when(F.col("drawdown") >= 0, 1))])
    sizes = marked.groupBy(*keys, "_island").agg(F.sum((F.col("drawdown") < 0).cast("long")).alias("_n"))
    return sizes.groupBy(*keys).agg(F.max("_n").alias("max_drawdown_duration"))


def trade_stats(pnls: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    p = F.col("pnl")
    wide = pnls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("average_trade"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_g"), F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("_l"))
    return wide.withColumn("profit_factor", F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).otherwise(F.col("_g"))).drop("_g", "_l")


# --- report queries ----------------------------------------------------------------------------

def widen_metrics(long: DataFrame, names: Sequence[str], keys: Sequence[str] = RUN) -> DataFrame:
    return long.groupBy(*keys).pivot("metric_name", list(names)).agg(F.max("metric_value"))


def run_instrument(run_id: str = "run_id", symbol: str = "symbol") -> Column:
    """Second part of a run id, else the run's symbol, else PORTFOLIO."""
    part = F.split_part(F.col(run_id), F.lit(":"), F.lit(2))
    return F.coalesce(F.nullif(part, F.lit("")), F.col(symbol), F.lit("PORTFOLIO"))


def _metric(name: str) -> Column:
    return F.when(F.col("metric_name") == name, F.col("metric_value"))


AGGREGATED = ("total_return", "win_rate", "sharpe", "max_drawdown", "profit_factor")


def strategy_aggregate(runs: DataFrame, long: DataFrame) -> DataFrame:
    """Runs, distinct instruments and mean metrics per strategy."""
    df = runs.withColumn("_stock", run_instrument()).join(long, "run_id", "left")
    return df.groupBy("strategy_name").agg(
        F.count_distinct("run_id").alias("total_runs"), F.count_distinct("_stock").alias("total_stocks"),
        *[F.avg(_metric(m)).alias(f"avg_{m}") for m in AGGREGATED])


def best_run_per_symbol(runs: DataFrame, long: DataFrame, trips: DataFrame) -> DataFrame:
    """The newest run of each instrument, runs with trades first, with its metrics and P&L."""
    traded = trips.groupBy("run_id").agg(F.count(F.lit(1)).alias("trades_found"), F.sum("net_pnl").alias("net_pnl"))
    df = runs.withColumn("instrument", run_instrument()).join(traded, "run_id", "left").na.fill(0, ["trades_found", "net_pnl"])
    w = Window.partitionBy("strategy_name", "instrument").orderBy((F.col("trades_found") > 0).desc(), F.col("started_at").desc(), F.col("run_id"))
    best = df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    wide = widen_metrics(long, ["total_return", "max_drawdown", "sharpe"])
    return best.join(wide, "run_id", "left").withColumn("has_trades", F.col("trades_found") > 0)


def stock_performance(trips: DataFrame, keys: Sequence[str] = ("run_id", "symbol")) -> DataFrame:
    return trips.groupBy(*keys).agg(
        F.sum("net_pnl").alias("pnl"), F.count(F.lit(1)).alias("trade_count"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"))


def trade_summary(trips: DataFrame, symbol: str | None = None, year: int | None = None, keys: Sequence[str] = RUN) -> DataFrame:
    """Wins, losses (zero counts as a loss), averages and profit factor of a run, a symbol or a year."""
    df = trips
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if year is not None:
        df = df.filter(F.year("exit_timestamp") == year)
    p = F.col("net_pnl")
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum((p > 0).cast("long")).alias("winning_trades"), F.sum((p <= 0).cast("long")).alias("losing_trades"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_profit_per_win"), F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss_per_loss"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("_g"), F.abs(F.sum(F.when(p < 0, p).otherwise(0.0))).alias("_l"), F.sum(p).alias("total_pnl"))
    return wide.withColumns({
        "win_rate": F.col("winning_trades") / F.col("total_trades"),
        "profit_factor": F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).otherwise(0.0)}).drop("_g", "_l")


def monthly_returns(curve: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Last over first equity inside each month (the overnight step into a month is not counted)."""
    df = curve.groupBy(*keys, F.year("timestamp").alias("year"), F.month("timestamp").alias("month")).agg(
        F.min_by("equity", "timestamp").alias("_a"), F.max_by("equity", "timestamp").alias("_b"))
    return df.withColumn("return_pct", F.when(F.col("_a") > 0, F.col("_b") / F.col("_a") - 1).otherwise(0.0)).drop("_a", "_b")


def monthly_symbol_returns(trips: DataFrame, capital: float = 100_000.0, keys: Sequence[str] = ("run_id", "symbol")) -> DataFrame:
    return trips.groupBy(*keys, F.year("exit_timestamp").alias("year"), F.month("exit_timestamp").alias("month")).agg(
        (F.sum("net_pnl") / capital).alias("return_pct"))


def trade_ledger_view(trips: DataFrame, run_id: str, symbol: str | None = None) -> DataFrame:
    df = trips.filter(F.col("run_id") == run_id)
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df.select(
        "trade_id", "symbol", "entry_timestamp", "exit_timestamp", "quantity", "entry_price", "exit_price",
        F.coalesce("gross_pnl", "net_pnl").alias("gross_pnl"), F.coalesce(F.col("entry_cost") + F.col("exit_cost"), F.lit(0.0)).alias("fees"), "net_pnl",
        F.coalesce("holding_period_days", F.lit(0.0)).alias("holding_period_days"), F.coalesce("entry_reason", F.lit("")).alias("entry_reason"),
        F.coalesce("exit_reason", F.lit("")).alias("exit_reason")).orderBy(F.col("exit_timestamp").desc())


def equity_curve_view(curve: DataFrame, run_id: str) -> DataFrame:
    return curve.filter(F.col("run_id") == run_id).select("timestamp", "equity", "drawdown").orderBy("timestamp")


def yearly_returns(monthly: DataFrame, keys: Sequence[str] = RUN, capital: float = 100_000.0) -> DataFrame:
    """Month, year and run totals in one rollup (NULL month or year marks a total)."""
    grouped = monthly.rollup(*keys, "year", "month")
    out = grouped.agg(F.sum("return_pct").alias("return_pct"), (F.sum("return_pct") * capital).alias("total_pnl"), F.count(F.lit(1)).alias("months"))
    return out.filter(" AND ".join(f"{k} IS NOT NULL" for k in cols(list(keys))))


def winners(best: DataFrame, keys: Sequence[str] = ("strategy_name",)) -> DataFrame:
    traded = F.col("has_trades")
    return best.groupBy(*keys).agg(
        F.sum((traded & (F.col("total_return") > 0)).cast("long")).alias("profitable"), F.sum((traded & (F.col("total_return") < 0)).cast("long")).alias("losing"),
        F.sum(traded.cast("long")).alias("with_trades"), F.avg(F.coalesce("total_return", F.lit(0.0))).alias("avg_return"))


def benchmark_relative(curve: DataFrame, benchmark: DataFrame, keys: Sequence[str] = RUN, timeframe: str = "1d") -> DataFrame:
    """Beta, annual alpha and information ratio against benchmark returns on shared timestamps."""
    factor = annualization_factor(timeframe)
    df = curve.join(benchmark, "timestamp")
    r, b = F.col("net_return"), F.col("benchmark_return")
    out = df.groupBy(*keys).agg(F.regr_slope(r, b).alias("beta"), F.avg(r).alias("_r"), F.avg(b).alias("_b"), F.avg(r - b).alias("_d"), F.stddev_pop(r - b).alias("_s"))
    return out.withColumns({
        "alpha": (F.col("_r") - F.coalesce("beta", F.lit(0.0)) * F.col("_b")) * factor,
        "information_ratio": F.when(F.col("_s") > 0, F.col("_d") / F.col("_s") * F.lit(factor**0.5)).otherwise(0.0)}).drop("_r", "_b", "_d", "_s")


def run_listing(table: DataFrame, newest: str, limit: int, ties: Sequence[str] = ()) -> DataFrame:
    """The newest rows of a table: a distributed top-k."""
    return table.orderBy(F.col(newest).desc(), *ties).limit(limit)
