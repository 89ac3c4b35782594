"""Universe membership, coverage, lookups and readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import first_per_key
from barlake.operators.features import session_date

FOREVER = "9999-12-31"


def normalize_symbol(value: Column) -> Column:
    """Trimmed upper case; empty becomes NULL."""
    return F.nullif(F.upper(F.trim(value)), F.lit(""))


def build_instrument_id(exchange: Column, symbol: Column, series: Column | None = None) -> Column:
    return F.concat_ws(":", F.upper(F.trim(exchange)), F.upper(F.trim(symbol)), F.upper(series if series is not None else F.lit("EQ")))


def import_members(constituents: DataFrame, instruments: DataFrame) -> DataFrame:
    """Attach provider symbol and token: the exact symbol first, else its ``-EQ`` listing."""
    known = instruments.select(F.col("symbol").alias("_key"), F.col("symbol").alias("provider_symbol"), F.col("token").alias("provider_token"))
    exact = known.select("_key", F.struct("provider_symbol", "provider_token").alias("_exact"))
    listed = known.select("_key", F.struct("provider_symbol", "provider_token").alias("_listed"))
    joined = constituents.join(exact, F.col("symbol") == exact["_key"], "left").drop("_key")
    joined = joined.join(listed, F.concat("symbol", F.lit("-EQ")) == listed["_key"], "left").drop("_key")
    hit = F.coalesce("_exact", "_listed")
    return joined.withColumns({"provider_symbol": hit["provider_symbol"], "provider_token": hit["provider_token"]}).drop("_exact", "_listed")


def eligible_members(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(F.col("active_to").isNull() & F.col("data_eligible") & F.col("provider_token").isNotNull())


def universe_as_of(intervals: DataFrame, day: str, known: str | None = None, name: str | None = None) -> DataFrame:
    """Members on ``day``, using only what was known by ``known``; half-open intervals, NULL end = open."""
    on = F.lit(day).cast("date")
    active = (F.col("effective_from") <= on) & (F.col("effective_until").isNull() | (F.col("effective_until") > on))
    df = intervals.filter(active)
    if known is not None:
        df = df.filter(F.col("known_from").isNull() | (F.col("known_from") <= F.lit(known).cast("date")))
    return df if name is None else df.filter(F.upper("universe_name") == name.upper())


def mark_pit(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Flag panel rows inside a membership interval.

    Intervals of one symbol are merged to one array row first, so the equi join on symbol can
    neither multiply panel rows nor need a nested loop; the range test is a row expression.
    """
    spans = intervals.groupBy("symbol").agg(
        F.collect_set(F.struct("effective_from", F.coalesce("effective_until", F.lit(FOREVER).cast("date")).alias("until"))).alias("_spans")
    )
    day = session_date()
    inside = F.exists("_spans", lambda s: (s["effective_from"] <= day) & (day < s["until"]))
    return panel.join(spans, "symbol", "left").withColumn("pit_eligible", F.coalesce(inside, F.lit(False))).drop("_spans")


def pit_coverage(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Reasons the membership evidence does not cover the panel."""
    dates = panel.agg(F.min(session_date()).alias("p0"), F.max(session_date()).alias("p1"))
    proof = intervals.agg(
        F.min("effective_from").alias("e0"),
        F.max(F.coalesce("effective_until", F.lit(FOREVER).cast("date"))).alias("e1"),
        F.sum(F.when(F.col("effective_until") <= F.col("effective_from"), 1).otherwise(0)).alias("bad"),
    )
    both = dates.select(F.lit(1).alias("_one"), "*").join(proof.select(F.lit(1).alias("_one"), "*"), "_one")
    reasons = F.array_compact(F.array(
        F.when(F.col("e0").isNull(), "NO_EVIDENCE"),
        F.when(F.col("e0") > F.col("p0"), "EVIDENCE_STARTS_AFTER_PANEL"),
        F.when(F.col("e1") <= F.col("p1"), "EVIDENCE_ENDS_BEFORE_PANEL"),
        F.when(F.col("bad") > 0, "INVALID_INTERVAL"),
    ))
    return both.select(F.explode(reasons).alias("reason"))


def interval_overlaps(intervals: DataFrame) -> DataFrame:
    """Memberships that start before an earlier one of the same instrument ends (no self-join)."""
    w = Window.partitionBy("universe_name", "instrument_id").orderBy("effective_from").rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce("effective_until", F.lit(FOREVER).cast("date"))
    return intervals.withColumn("previous_until", F.max(until).over(w)).filter(F.col("previous_until") > F.col("effective_from"))


def universe_history(intervals: DataFrame, name: str) -> DataFrame:
    """Additions and removals of one universe as events."""
    members = intervals.filter(F.upper("universe_name") == name.upper())
    events = F.array_compact(F.array(
        F.struct(F.col("effective_from").alias("event_date"), F.lit("ADD").alias("event")),
        F.when(F.col("effective_until").isNotNull(), F.struct(F.col("effective_until").alias("event_date"), F.lit("REMOVE").alias("event"))),
    ))
    return members.select("universe_name", "instrument_id", "symbol", F.inline(events))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "timeframe").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count(F.lit(1)).alias("bars"))


def latest_bar(bars: DataFrame, columns: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    row = F.max_by(F.struct(*columns), "timestamp")
    latest = bars.groupBy("symbol", "timeframe").agg(F.max("timestamp").alias("timestamp"), row.alias("_row"))
    return latest.select("symbol", "timeframe", "timestamp", "_row.*")


def distinct_symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def resolve_benchmark(requested: DataFrame, aliases: DataFrame, bars: DataFrame) -> DataFrame:
    """Own data first, else the best approved alias (EXACT before PROXY)."""
    have = distinct_symbols(bars)
    own = requested.join(have, "symbol", "left_semi").select("symbol", F.col("symbol").alias("provider_symbol"), F.lit("EXACT").alias("relationship"))
    rest = requested.join(have, "symbol", "left_anti")
    ranked = first_per_key(
        aliases.filter("approved_for_research"), "canonical_symbol",
        [F.when(F.col("relationship") == "EXACT", 0).otherwise(1), F.col("provider_symbol")],
    )
    through = rest.join(ranked, rest.symbol == ranked.canonical_symbol).select("symbol", "provider_symbol", "relationship")
    return own.unionByName(through)


def index_key(name: Column) -> Column:
    """Upper case without punctuation or spaces."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def find_index(instruments: DataFrame, name: str) -> DataFrame:
    return instruments.filter(index_key(F.col("name")) == index_key(F.lit(name)))


# Cash-segment aliases.
SEGMENT_ALIASES: Mapping[str, str] = {"NSE": "NSE_CM", "NSE_CM": "NSE", "BSE": "BSE_CM", "BSE_CM": "BSE", "NFO": "NSE_FO", "NSE_FO": "NFO"}


def _alias(segment: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SEGMENT_ALIASES.items() for x in pair])[segment]


def resolve_token(requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Token of (exchange, symbol); a miss is retried on the aliased segment."""
    exact = instruments.select(F.col("exchange").alias("_e1"), F.col("symbol").alias("_s1"), F.col("token").alias("_t1"))
    other = instruments.select(F.col("exchange").alias("_e2"), F.col("symbol").alias("_s2"), F.col("token").alias("_t2"))
    df = requests.join(exact, (F.col("exchange") == F.col("_e1")) & (F.col("symbol") == F.col("_s1")), "left")
    df = df.join(other, (_alias(F.col("exchange")) == F.col("_e2")) & (F.col("symbol") == F.col("_s2")), "left")
    return df.withColumn("token", F.coalesce("_t1", "_t2")).drop("_e1", "_s1", "_t1", "_e2", "_s2", "_t2")


def search_symbol(instruments: DataFrame, text: str) -> DataFrame:
    """Case-insensitive containment."""
    return instruments.filter(F.contains(F.upper("symbol"), F.lit(text.upper())))


def sector_map(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Sector by symbol, else by provider symbol, else UNKNOWN."""
    names = members.select(F.explode(F.array_distinct(F.array("symbol", "provider_symbol"))).alias("symbol"), "sector")
    one = names.filter("symbol IS NOT NULL").groupBy("symbol").agg(F.min("sector").alias("_sector"))
    return panel.drop("sector").join(one, "symbol", "left").withColumn("sector", F.coalesce("_sector", F.lit("UNKNOWN"))).drop("_sector")


def missing_sectors(panel: DataFrame, members: DataFrame) -> DataFrame:
    return sector_map(panel.select("symbol").distinct(), members).filter("sector = 'UNKNOWN'").select("symbol")


def infer_market(instruments: DataFrame) -> DataFrame:
    """Asset class, currency, time zone, hours, lot and tick by exchange and instrument type."""
    exchange, kind = F.upper("exchange"), F.upper(F.coalesce("instrument_type", F.lit("")))
    derivative = exchange.isin("NFO", "NSE_FO", "BFO", "BSE_FO")
    commodity = exchange.isin("MCX", "MCX_FO", "NCDEX", "NCX_FO")
    currency = exchange.isin("CDS", "CDE_FO")
    crypto = exchange.isin("CRYPTO", "BINANCE")
    asset = (
        F.when(crypto, "CRYPTO").when(commodity, "COMMODITY").when(currency, "FOREX")
        .when(derivative & kind.startswith("OPT"), "OPTION").when(derivative, "FUTURE")
        .when(kind.contains("IDX") | kind.contains("INDEX"), "INDEX").otherwise("INDIA_EQUITY")
    )
    close = F.when(crypto, "23:59").when(exchange.isin("MCX", "MCX_FO"), "23:30").when(currency | exchange.isin("NCDEX", "NCX_FO"), "17:00").otherwise("15:30")
    opening = F.when(crypto, "00:00").when(commodity | currency, "09:00").otherwise("09:15")
    return instruments.withColumns({
        "asset_class": asset,
        "currency": F.when(crypto, "USD").otherwise("INR"),
        "timezone": F.when(crypto, "UTC").otherwise("Asia/Kolkata"),
        "session_open": opening, "session_close": close,
        "lot_size": F.coalesce(F.col("lot_size"), F.lit(1)) if "lot_size" in instruments.columns else F.lit(1),
        "tick_size": F.when(currency, 0.0025).otherwise(0.05),
    })


def readiness(
    members: DataFrame, bars: DataFrame, quality: DataFrame, benchmark: DataFrame,
    timeframe: str = "1d", min_bars: int = 253, fraction: float = 0.8, expected: int = 200,
) -> DataFrame:
    """One row: is a universe snapshot fit for research, with blockers and warnings.

    ``benchmark`` is one row (provider_symbol, relationship) as resolved before.  Bars are
    counted per symbol first, so only counts meet the members.
    """
    active = members.filter(F.col("active_to").isNull() & F.col("data_eligible"))
    sizes = bars.filter(F.col("timeframe") == timeframe).groupBy(F.col("symbol").alias("_bar_symbol")).agg(F.count(F.lit(1)).alias("_bars"))
    per = active.join(sizes, F.col("provider_symbol") == F.col("_bar_symbol"), "left").groupBy("symbol").agg(
        F.sum(F.coalesce("_bars", F.lit(0))).alias("n"), F.count("provider_token").alias("tokens"), F.count(F.lit(1)).alias("members"))
    counts = per.agg(
        F.coalesce(F.sum("members"), F.lit(0)).alias("member_count"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("token_count"),
        F.coalesce(F.sum((F.col("n") > 0).cast("int")), F.lit(0)).alias("symbols_with_data"),
        F.coalesce(F.sum((F.col("n") >= min_bars).cast("int")), F.lit(0)).alias("symbols_with_lookback"))
    names = members.select("symbol").union(members.select("provider_symbol")).union(benchmark.select("provider_symbol")).distinct()
    latest = quality.filter((F.col("timeframe") == timeframe) & (F.col("check_type") == "session_alignment")).groupBy("symbol").agg(
        F.max_by("issue_count", "checked_at").alias("issues"))
    calendar = latest.join(names, "symbol", "left_semi").agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("calendar_exceptions"))
    bench = benchmark.join(sizes, F.col("provider_symbol") == F.col("_bar_symbol"), "left").agg(
        F.first("provider_symbol").alias("benchmark_symbol"), F.first("relationship").alias("benchmark_relationship"),
        F.coalesce(F.sum("_bars"), F.lit(0)).alias("benchmark_rows"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(counts).join(one(calendar), "_one").join(one(bench), "_one").drop("_one")
    need = F.ceil(F.col("member_count") * F.lit(fraction)).cast("long")
    short = F.col("symbols_with_lookback") < need
    text = lambda name, value: F.concat(F.lit(name + ":"), value.cast("string"))
    blockers = F.array_compact(F.array(
        F.when(F.col("member_count") != expected, text("SNAPSHOT_MEMBER_COUNT", F.col("member_count"))),
        F.when(F.col("token_count") < F.col("member_count"), text("MISSING_PROVIDER_TOKENS", F.col("member_count") - F.col("token_count"))),
        F.when(F.col("symbols_with_data") < F.col("member_count"), text("MISSING_MEMBER_DATA", F.col("member_count") - F.col("symbols_with_data"))),
        F.when(short, F.concat(F.lit("INSUFFICIENT_ELIGIBLE_UNIVERSE:"), F.col("symbols_with_lookback").cast("string"), F.lit("/"), need.cast("string"))),
        F.when(F.col("benchmark_rows") < min_bars, text("BENCHMARK_LOOKBACK", F.col("benchmark_rows"))),
        F.when(F.col("calendar_exceptions") > 0, text("UNRESOLVED_CALENDAR_EXCEPTIONS", F.col("calendar_exceptions"))),
    ))
    warnings = F.array_compact(F.array(
        F.when(~short & (F.col("symbols_with_lookback") < F.col("member_count")),
               text("SHORT_LISTING_HISTORY", F.col("member_count") - F.col("symbols_with_lookback")))))
    return row.withColumns({"blockers": blockers, "warnings": warnings}).withColumn("ready", F.size("blockers") == 0)
