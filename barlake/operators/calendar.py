"""Trading sessions as a generated table, and everything joined to it by local date."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.features import LOCAL_TZ, session_date

# Session hours by market segment, local time.
SEGMENT_HOURS = {
    "NSE_CM": ("09:15", "15:30"), "BSE_CM": ("09:15", "15:30"), "NSE": ("09:15", "15:30"), "BSE": ("09:15", "15:30"),
    "NSE_FO": ("09:15", "15:30"), "BSE_FO": ("09:15", "15:30"), "NFO": ("09:15", "15:30"), "BFO": ("09:15", "15:30"),
    "CDE_FO": ("09:00", "17:00"), "CDS": ("09:00", "17:00"), "MCX_FO": ("09:00", "23:30"), "MCX": ("09:00", "23:30"),
    "NCX_FO": ("09:00", "17:00"), "NCDEX": ("09:00", "17:00"),
}
DEFAULT_HOURS = ("09:15", "15:30")
SESSION_MINUTES = 375


def _at(day: Column, clock: Column) -> Column:
    """UTC instant of a local wall-clock time on a date."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), clock), "yyyy-MM-dd HH:mm"), LOCAL_TZ)


def sessions(bounds: DataFrame, overrides: DataFrame, hours: tuple[str, str] = DEFAULT_HOURS, market: str = "equity") -> DataFrame:
    """Trading days between one row of ``start`` and ``end`` with their open and close instants.

    ``overrides`` (session_date, kind, open_time, close_time) closes days or declares special
    sessions; holidays are CLOSED rows.  A crypto market trades every day.
    """
    days = bounds.select(F.explode(F.sequence("start", "end")).alias("session_date"))
    named = overrides.filter(F.col("kind").isin("CLOSED", "SPECIAL_SESSION")).groupBy("session_date").agg(
        F.max((F.col("kind") == "CLOSED").cast("int")).alias("_closed"),
        F.max((F.col("kind") == "SPECIAL_SESSION").cast("int")).alias("_special"),
        F.max(F.when(F.col("kind") == "SPECIAL_SESSION", F.col("open_time"))).alias("_open"),
        F.max(F.when(F.col("kind") == "SPECIAL_SESSION", F.col("close_time"))).alias("_close"),
    )
    df = days.join(named, "session_date", "left").na.fill(0, ["_closed", "_special"])
    ordinary = F.lit(True) if market == "crypto" else F.weekday("session_date") < 5
    df = df.filter((F.col("_closed") == 0) & ((F.col("_special") == 1) | ordinary))
    day = F.col("session_date")
    return df.select(
        "session_date",
        F.when(F.col("_special") == 1, "SPECIAL_SESSION").otherwise("REGULAR").alias("kind"),
        _at(day, F.coalesce("_open", F.lit(hours[0]))).alias("open_at"),
        _at(day, F.coalesce("_close", F.lit(hours[1]))).alias("close_at"),
    )


def session_flags(df: DataFrame, calendar: DataFrame, ts: str = "timestamp") -> DataFrame:
    """is_trading_day and is_session_open (both ends included)."""
    dated = df.withColumn("session_date", session_date(ts))
    known = calendar.select("session_date", F.col("open_at").alias("_open"), F.col("close_at").alias("_close"))
    out = dated.join(known, "session_date", "left")
    return out.withColumns({
        "is_trading_day": F.col("_open").isNotNull(),
        "is_session_open": F.coalesce(F.col(ts).between(F.col("_open"), F.col("_close")), F.lit(False)),
    }).drop("_open", "_close")


def segment_hours(df: DataFrame, exchange: str = "exchange") -> DataFrame:
    """Session hours of the row's market segment, with a default."""
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in SEGMENT_HOURS.items() for x in (k, v[i])])[F.upper(F.trim(exchange))]
    return df.withColumns({
        "segment_open": F.coalesce(pick(0), F.lit(DEFAULT_HOURS[0])), "segment_close": F.coalesce(pick(1), F.lit(DEFAULT_HOURS[1]))})


def session_bar_index(bars: DataFrame) -> DataFrame:
    """0-based bar number inside the local session; a session of one symbol is bounded by the bar key."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "_day").orderBy("timestamp")
    return bars.withColumn("_day", session_date()).withColumn("session_bar_index", F.row_number().over(w) - 1).drop("_day")


def session_progress(df: DataFrame, calendar: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Elapsed share of the session in 0..1, NULL where there is no session."""
    dated = df.withColumn("session_date", session_date(ts))
    joined = dated.join(calendar.select("session_date", "open_at", "close_at"), "session_date", "left")
    span = F.col("close_at").cast("double") - F.col("open_at").cast("double")
    share = (F.col(ts).cast("double") - F.col("open_at").cast("double")) / F.nullif(span, F.lit(0.0))
    clipped = F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return joined.withColumn("session_progress", clipped).drop("open_at", "close_at", "session_date")


def drop_out_of_session(bars: DataFrame, calendar: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Daily bars on session days; intraday bars inside session hours."""
    flagged = session_flags(bars, calendar)
    keep = F.col("is_trading_day") if timeframe == "1d" else F.col("is_session_open")
    return flagged.filter(keep).drop("is_trading_day", "is_session_open", "session_date")


def annualization(timeframe: Column, session_minutes: float = SESSION_MINUTES) -> Column:
    """252 sessions times the bars one session holds."""
    label = F.lower(timeframe)
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(label, r"^(\d+)", 1), F.lit("")), F.lit("99999")).cast("double"), F.lit(1.0))
    minutes = F.when(label.endswith("m"), number).when(label.endswith("h"), number * 60)
    per_day = F.greatest(F.bround(F.lit(float(session_minutes)) / minutes), F.lit(1.0))
    return F.lit(252.0) * F.coalesce(per_day, F.lit(1.0))


def annualization_factor(timeframe: str, session_minutes: float = SESSION_MINUTES) -> float:
    """The same for one known timeframe."""
    match = re.fullmatch(r"(\d*)([mh])", timeframe.lower())
    if not match:
        return 252.0
    minutes = int(match[1] or 1) * (60 if match[2] == "h" else 1)
    return 252.0 * max(round(session_minutes / minutes), 1)


def completed_only(bars: DataFrame, calendar: DataFrame, as_of: Column) -> DataFrame:
    """Bars whose session has closed by ``as_of``."""
    closed = calendar.filter(F.col("close_at") <= as_of).select("session_date")
    return bars.withColumn("session_date", session_date()).join(closed, "session_date", "left_semi").drop("session_date")


def latest_completed_session(calendar: DataFrame, now: Column) -> DataFrame:
    return calendar.filter(F.col("close_at") <= now).agg(F.max("session_date").alias("session_date"))


def backfill_plan(bars: DataFrame, symbols: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Date windows still to fetch: before the earliest and after the latest stored bar of each symbol."""
    have = bars.groupBy("symbol").agg(F.min(session_date()).alias("first"), F.max(session_date()).alias("last"))
    first_day, last_day = F.lit(start).cast("date"), F.lit(end).cast("date")
    df = symbols.join(have, "symbol", "left")
    before = F.struct(first_day.alias("a"), F.coalesce(F.date_sub("first", 1), last_day).alias("b"))
    after = F.when(F.col("last").isNotNull(), F.struct(F.date_add("last", 1).alias("a"), last_day.alias("b")))
    spans = df.select("symbol", F.explode(F.array_compact(F.array(before, after))).alias("s")).filter("s.a <= s.b")
    steps = F.sequence(F.col("s.a"), F.col("s.b"), F.expr(f"INTERVAL '{days}' DAY"))
    cut = spans.select("symbol", F.col("s.b").alias("_end"), F.explode(steps).alias("window_start"))
    return cut.select("symbol", "window_start", F.least(F.date_add("window_start", days - 1), F.col("_end")).alias("window_end"))


