"""Causal per-symbol features, cross-section statistics and the synchronized panel.

Every per-symbol feature is a window over bounded blocks (see functions.windows), so
one plan serves all symbols and no symbol is a single task.  NULL rules: simple means,
deviations and extremes stay NULL until their frame is full; ATR and z-scores do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import INDEX, Running, Series, add_ema, ema_lookback, full, scan, series, zscore

SHORT, MEDIUM, LONG = 5, 20, 50
LOCAL_TZ = "Asia/Kolkata"


def bar_series(bars: DataFrame, lookback: int = MEDIUM, **kw) -> Series:
    return series(bars, "symbol", ("timestamp",), lookback=lookback, **kw)


def finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where the quotient does not exist."""
    return top / F.nullif(bottom, F.lit(0.0))


def change(s: Series, value: str, periods: int = 1) -> Column:
    """Relative change over ``periods`` rows; NULL in, NULL out."""
    return ratio(F.col(value), F.lag(value, periods).over(s.w)) - 1


def add_returns(s: Series) -> Series:
    before = F.lag("close").over(s.w)
    log_ratio = ratio(F.col("close"), before)
    return s.with_columns({
        "return_1": F.coalesce(change(s, "close"), F.lit(0.0)),
        "log_return_1": F.coalesce(F.when(log_ratio > 0, F.log(log_ratio)), F.lit(0.0)),
        "gap_return": F.coalesce(ratio(F.col("open"), before) - 1, F.lit(0.0)),
        "range_pct": F.coalesce(ratio(F.col("high") - F.col("low"), F.col("close")), F.lit(0.0)),
    })


def sma(s: Series, n: int, value: str = "close") -> Column:
    return full(s, F.avg(value), value, n)


def add_averages(s: Series) -> Series:
    return s.with_columns({"sma_short": sma(s, SHORT), "sma_medium": sma(s, MEDIUM), "sma_long": sma(s, LONG)})


def add_emas(s: Series, fast: int = 2 * SHORT, slow: int = 2 * MEDIUM) -> Series:
    return add_ema(add_ema(s, "close", fast, "ema_fast"), "close", slow, "ema_slow")


def volatility(s: Series, n: int = MEDIUM) -> Column:
    """Sample deviation of log returns, 0 until the frame is full. Needs ``log_return_1``."""
    return F.coalesce(full(s, F.stddev_samp("log_return_1"), "log_return_1", n), F.lit(0.0))


def true_range(s: Series) -> Column:
    before = F.lag("close").over(s.w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def add_atr(s: Series, n: int = MEDIUM) -> Series:
    ranged = s.with_columns({"true_range": true_range(s)})
    return ranged.with_columns({"atr": F.avg("true_range").over(ranged.rows(n))})


def add_channel(s: Series, n: int = MEDIUM) -> Series:
    return s.with_columns({"rolling_high": full(s, F.max("high"), "high", n), "rolling_low": full(s, F.min("low"), "low", n)})


def add_volume(s: Series, n: int = MEDIUM) -> Series:
    return s.with_columns({"volume_sma": sma(s, n, "volume"), "volume_zscore": zscore(s, "volume", n)})


def trend_strength(sma_medium: str = "sma_medium") -> Column:
    return F.coalesce(ratio(F.col("close"), F.col(sma_medium)) - 1, F.lit(0.0))


FEATURE_COLUMNS = (
    "return_1", "log_return_1", "gap_return", "range_pct", "sma_short", "sma_medium", "sma_long", "ema_fast", "ema_slow",
    "volatility", "true_range", "atr", "trend_strength", "price_zscore", "volume_sma", "volume_zscore", "rolling_high", "rolling_low",
)


def build_features(bars: DataFrame, ema: bool = True, keep_index: bool = False, **kw) -> DataFrame:
    """All features in one plan: one indexing pass and one window shuffle."""
    lookback = ema_lookback(2 * MEDIUM) if ema else LONG
    clean = bars.dropna(subset=["timestamp", "open", "high", "low", "close", "volume"])
    s = add_channel(add_volume(add_atr(add_averages(add_returns(bar_series(clean, lookback, **kw))))))
    if ema:
        s = add_emas(s)
    s = s.with_columns({
        "volatility": volatility(s),
        "trend_strength": trend_strength(),
        "price_zscore": zscore(s, "close", MEDIUM),
        "feature_available_at": F.col("timestamp"),
    })
    return s.done(keep_index)


def lagged_liquidity(bars: DataFrame, n: int = 20, **kw) -> DataFrame:
    """What was known before each bar: mean volume of up to n rows before it, last close, their product."""
    s = bar_series(bars, n, **kw)
    s = s.with_columns({"lagged_adv": F.avg("volume").over(s.prior(n)), "lagged_close": F.lag("close").over(s.w)})
    return s.with_columns({"lagged_traded_value": F.col("lagged_close") * F.col("lagged_adv")}).done()


def add_beta(s: Series, n: int, name: str = "beta") -> Series:
    """Covariance over variance of daily changes, both over the same n complete pairs."""
    s = s.with_columns({"_rs": change(s, "close"), "_rb": change(s, "benchmark_close")})
    pair = F.when(F.col("_rs").isNotNull() & F.col("_rb").isNotNull(), 1)
    whole = F.count(pair).over(s.rows(n)) == n
    beta = F.covar_samp("_rs", "_rb").over(s.rows(n)) / F.nullif(F.var_samp("_rb").over(s.rows(n)), F.lit(0.0))
    s = s.with_columns({name: F.when(whole, beta)})
    return Series(s.df.drop("_rs", "_rb"), s.keys)


def add_rsi(s: Series, n: int, name: str = "rsi") -> Series:
    """Simple-mean relative strength; NULL while the frame is short or holds no loss."""
    s = s.with_columns({"_delta": F.col("close") - F.lag("close").over(s.w)})
    up, down = F.greatest(F.col("_delta"), F.lit(0.0)), -F.least(F.col("_delta"), F.lit(0.0))
    s = s.with_columns({"_up": F.when(F.col("_delta").isNotNull(), up), "_down": F.when(F.col("_delta").isNotNull(), down)})
    strength = ratio(full(s, F.avg("_up"), "_up", n), full(s, F.avg("_down"), "_down", n))
    s = s.with_columns({name: F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + strength)})
    return Series(s.df.drop("_delta", "_up", "_down"), s.keys)


def add_bollinger(s: Series, n: int = 20, k: float = 2.0) -> Series:
    mean = sma(s, n)
    return s.with_columns({"band_mid": mean, "band_low": mean - F.lit(k) * full(s, F.stddev_pop("close"), "close", n)})


def prior_full(s: Series, fn: Column, value: str, n: int) -> Column:
    """A frame aggregate over exactly the n rows before the current one."""
    return F.when(F.count(value).over(s.prior(n)) == n, fn.over(s.prior(n)))


def add_donchian(s: Series, high_n: int, low_n: int) -> Series:
    return s.with_columns({
        "prior_high": prior_full(s, F.max("high"), "high", high_n),
        "prior_low": prior_full(s, F.min("low"), "low", low_n),
    })


def add_contraction(s: Series, n: int = 20, q: float = 0.25, span: int = 100, recent: int = 5) -> Series:
    """Band width, its lagged rolling quantile, and whether the band was narrow lately."""
    width = ratio(F.lit(4.0) * full(s, F.stddev_pop("close"), "close", n), sma(s, n))
    s = s.with_columns({"band_width": width})
    s = s.with_columns({"_threshold": full(s, F.percentile("band_width", F.lit(q)), "band_width", span)})
    s = s.with_columns({"width_threshold": F.lag("_threshold").over(s.w), "_narrow": F.lag("band_width").over(s.w)})
    s = s.with_columns({"_narrow": F.coalesce(F.col("_narrow") <= F.col("width_threshold"), F.lit(False)).cast("int")})
    seen = F.col(INDEX) >= recent - 1
    s = s.with_columns({"recently_contracted": seen & (F.max("_narrow").over(s.rows(recent)) == 1)})
    return Series(s.df.drop("_threshold", "_narrow"), s.keys)


def month_key(ts: str = "timestamp") -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_end_flag(bars: DataFrame, per_symbol: bool = True) -> DataFrame:
    """Flag the last row of each calendar month, per symbol or over the whole panel.

    A symbol's month is bounded by the bar key; the month of a whole panel is not, so its
    last timestamp is a partial aggregate joined back.
    """
    df = bars.withColumn("_month", month_key())
    if per_symbol:
        last = F.max("timestamp").over(Window.partitionBy("symbol", "_month"))
        return df.withColumn("month_end", F.col("timestamp") == last).drop("_month")
    ends = df.groupBy("_month").agg(F.max("timestamp").alias("_last"))
    return df.join(ends, "_month").withColumn("month_end", F.col("timestamp") == F.col("_last")).drop("_last", "_month")


def n_period_return(bars: DataFrame, periods: Sequence[int], **kw) -> DataFrame:
    s = bar_series(bars, max(periods), **kw)
    return s.with_columns({f"ret_{p}": change(s, "close", p) for p in periods}).done()


def add_date_zscore(panel: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Cross-section z per timestamp (sample deviation).

    (symbol, timestamp) is the key of bars, so one timestamp holds at most one row per
    listed instrument and the window over it is bounded however long the history is.
    """
    w = Window.partitionBy("timestamp")
    return panel.withColumns({
        f"{c}{suffix}": (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)) for c in columns
    })


def session_date(ts: str = "timestamp") -> Column:
    """Local calendar date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, LOCAL_TZ))


def panel_problems(bars: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Reasons a panel must not be built: mixed adjustment, duplicate keys, missing benchmark."""
    bases = bars.agg(F.collect_set("adjustment").alias("a")).filter(F.size("a") > 1)
    mixed = bases.select(F.lit("MIXED_ADJUSTMENT").alias("problem"), F.size("a").cast("long").alias("rows"))
    repeated = bars.groupBy("symbol", "timestamp").count().filter("count > 1")
    dup = repeated.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0").select(F.lit("DUPLICATE_KEYS").alias("problem"), "rows")
    problems = mixed.union(dup)
    if benchmark is not None:
        lost = bars.select("timestamp").distinct().join(benchmark, "timestamp", "left_anti").agg(F.count(F.lit(1)).alias("rows"))
        problems = problems.union(lost.filter("rows > 0").select(F.lit("MISSING_BENCHMARK").alias("problem"), "rows"))
    return problems


def build_panel(
    bars: DataFrame,
    benchmark: DataFrame,
    intervals: DataFrame | None = None,
    min_lookback: int = 253,
    sectors: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """One row per (symbol, timestamp) with features, benchmark, eligibility and point-in-time flags."""
    from barlake.operators.universe import mark_pit

    featured = build_features(bars, keep_index=True, **kw).withColumn("observation_count", F.col(INDEX) + 1)
    if sectors is not None:
        featured = featured.drop("sector").join(sectors, "symbol", "left")
    if "sector" in featured.columns:
        featured = featured.withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))
    panel = featured.join(benchmark, "timestamp", "left").withColumn(
        "eligible", (F.col("observation_count") >= min_lookback) & F.col("benchmark_close").isNotNull()
    )
    return mark_pit(panel, intervals) if intervals is not None else panel.withColumn("pit_eligible", F.lit(True))


def panel_exclusions(bars: DataFrame, members: DataFrame, sessions: DataFrame, as_of: Column, stale_days: int = 7) -> DataFrame:
    """Members that cannot be used and the sessions they miss inside their own range."""
    dated = bars.select("symbol", session_date().alias("session_date")).distinct()
    valid = dated.join(sessions.select("session_date"), "session_date", "left_semi")
    bounds = valid.groupBy("symbol").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    none = members.join(dated, "symbol", "left_anti").select("symbol", F.lit("MISSING_DATA").alias("reason"), F.lit("").alias("detail"))
    unusable = (
        members.join(dated, "symbol", "left_semi").join(bounds, "symbol", "left_anti")
        .select("symbol", F.lit("NO_VALID_SESSIONS").alias("reason"), F.lit("").alias("detail"))
    )
    stale = bounds.join(members, "symbol", "left_semi").filter(F.datediff(as_of, "last") > stale_days).select(
        "symbol", F.lit("STALE_PRICE").alias("reason"), F.date_format("last", "yyyy-MM-dd").alias("detail")
    )
    missing = missing_days(bounds.join(members, "symbol", "left_semi"), valid, sessions)
    gaps = missing.select("symbol", F.lit("MISSING_SESSION").alias("reason"), F.date_format("session_date", "yyyy-MM-dd").alias("detail"))
    return none.unionByName(unusable).unionByName(stale).unionByName(gaps)


def missing_days(bounds: DataFrame, observed: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions between ``first`` and ``last`` of each symbol with no observation.

    The expected grid is the symbol's own day sequence, filtered by an equi join on the date.
    """
    grid = bounds.select("symbol", F.explode(F.sequence("first", "last")).alias("session_date"))
    expected = grid.join(sessions.select("session_date"), "session_date", "left_semi")
    return expected.join(observed, ["symbol", "session_date"], "left_anti")


def time_split(df: DataFrame, fraction: float, keys: str | Sequence[str] = "symbol", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Label the first floor(n * fraction) rows of each key TRAIN and the rest TEST; both get a row at least."""
    names = [keys] if isinstance(keys, str) else list(keys)
    numbered = scan(df, names, order, [Running("_n", "count", F.lit(1))])
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_total"))
    cut = F.greatest(F.lit(1), F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(fraction))))
    return numbered.join(sizes, names).withColumn("part", F.when(F.col("_n") <= cut, "TRAIN").otherwise("TEST")).drop("_n", "_total")
