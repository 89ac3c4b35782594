"""Intake cleaning, structural validation, quality checks and certification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import INDEX, Series, first_per_key, series
from barlake.operators.features import LOCAL_TZ, missing_days, session_date

OHLCV = ("open", "high", "low", "close", "volume")
# The checks a certificate needs, and each check's severity.
REQUIRED_CHECKS = ("schema", "ohlc_integrity", "duplicates", "session_alignment", "missing_sessions", "timestamp_integrity")
CHECK_SEVERITY = {
    "schema": "CRITICAL", "duplicates": "CRITICAL", "future_timestamps": "CRITICAL", "null_values": "CRITICAL",
    "ohlc_integrity": "CRITICAL", "timestamp_integrity": "CRITICAL", "missing_candles": "ERROR", "session_alignment": "ERROR",
    "missing_sessions": "ERROR", "anomalies": "WARNING",
}


def codes(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))


# --- cleaning ------------------------------------------------------------------------------

def _typed(df: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: F.when(~F.isnan(number(c)), number(c))
    return df.withColumns({"timestamp": F.col("timestamp").try_cast("timestamp"), **{c: finite(c) for c in OHLCV}})


def _sane(close_positive: bool) -> Column:
    ok = (
        (F.col("volume") >= 0) & (F.col("open") > 0) & (F.col("high") >= F.greatest("open", "close"))
        & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.col("low"))
    )
    return ok & (F.col("close") > 0) if close_positive else ok


def clean_bars(raw: DataFrame, keys: Sequence[str] = ("symbol", "timestamp"), order: str = "source_row_number") -> DataFrame:
    """Typed bars without NULLs, impossible prices or repeated timestamps (first valid row wins)."""
    rows = _typed(raw).dropna(subset=["timestamp", *OHLCV]).filter(_sane(False))
    return first_per_key(rows, keys, [F.col(order)]).withColumn("volume", F.col("volume").cast("long"))


def snapshot_bars(raw: DataFrame, keys: Sequence[str] = ("symbol", "timestamp"), order: str = "source_row_number") -> DataFrame:
    """As ``clean_bars`` with a positive close, but the first row of a timestamp is chosen before the price rules."""
    rows = _typed(raw).dropna(subset=["timestamp", *OHLCV])
    return first_per_key(rows, keys, [F.col(order)]).filter(_sane(True))


def empty_snapshots(raw: DataFrame, cleaned: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Datasets of which nothing survived."""
    return raw.select(key).distinct().join(cleaned.select(key).distinct(), key, "left_anti")


def localize_ts(df: DataFrame, column: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Naive timestamps are local time; aware ones are left as instants."""
    if dict(df.dtypes)[column] == "timestamp":
        return df
    return df.withColumn(column, F.to_utc_timestamp(F.col(column).cast("timestamp"), tz))


# --- raw validation --------------------------------------------------------------------------

def validate_raw(raw: DataFrame) -> DataFrame:
    """One row per issue of every provider row; nothing is dropped silently.

    A missing field ends the row's checks, and an unparsable number skips its price rules.
    A repeated timestamp is any row after the dataset's first with that instant: the first
    row number per instant is a partial aggregate joined back, so a hot instant is not one task.
    """
    keyed = raw.withColumns({
        "_ts": F.try_to_timestamp(F.nullif(F.trim("timestamp"), F.lit(""))),
        **{f"_{c}": F.col(c).try_cast("double") for c in OHLCV},
    })
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("timestamp", *OHLCV)])
    first = (
        keyed.filter(~absent & F.col("_ts").isNotNull()).groupBy("dataset_id", "_ts")
        .agg(F.min("source_row_number").alias("_first")).withColumnRenamed("_ts", "_at").withColumnRenamed("dataset_id", "_ds")
    )
    rows = keyed.join(first, (F.col("dataset_id") == F.col("_ds")) & (F.col("_ts") == F.col("_at")), "left").drop("_ds", "_at")
    blank = (F.trim("timestamp") == "") | (F.lower("timestamp") == "nan")
    finite = {c: F.col(f"_{c}").isNotNull() & ~F.isnan(f"_{c}") & (F.abs(f"_{c}") != float("inf")) for c in OHLCV}
    parsed = reduce(lambda a, b: a & b, finite.values())
    v = {c: F.col(f"_{c}") for c in OHLCV}
    rules = [
        ("TIMESTAMP_MISSING", blank),
        ("TIMESTAMP_INVALID", ~blank & F.col("_ts").isNull()),
        ("TIMESTAMP_DUPLICATE", F.col("_ts").isNotNull() & (F.col("source_row_number") > F.col("_first"))),
        *[(f"{c.upper()}_NON_FINITE", F.col(f"_{c}").isNotNull() & ~finite[c]) for c in OHLCV],
        *[("NUMERIC_PARSE_FAILED", F.col(f"_{c}").isNull()) for c in OHLCV],
        *[(f"{c.upper()}_NON_POSITIVE", parsed & (v[c] <= 0)) for c in OHLCV[:4]],
        ("VOLUME_NEGATIVE", parsed & (v["volume"] < 0)),
        ("HIGH_BELOW_OPEN", parsed & (v["high"] < v["open"])),
        ("HIGH_BELOW_CLOSE", parsed & (v["high"] < v["close"])),
        ("LOW_ABOVE_OPEN", parsed & (v["low"] > v["open"])),
        ("LOW_ABOVE_CLOSE", parsed & (v["low"] > v["close"])),
        ("HIGH_BELOW_LOW", parsed & (v["high"] < v["low"])),
    ]
    found = F.when(absent, F.array(F.lit("UNEXPECTED_SCHEMA"))).otherwise(codes(rules))
    return rows.select("dataset_id", "source_row_number", F.when(~absent, F.col("_ts")).alias("event_timestamp"), F.explode(found).alias("reason_code"))


def quarantine_split(raw: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a dataset with any issue is set aside whole."""
    bad = issues.select("dataset_id").distinct()
    return raw.join(bad, "dataset_id", "left_anti"), raw.join(bad, "dataset_id", "left_semi")


def dataset_hash(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint per key: row hashes combined by sum and xor, then digested."""
    row = F.xxhash64(*[F.col(c) for c in columns])
    parts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("_x"), F.sum(row.cast("decimal(38,0)")).alias("_s"))
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("_x").cast("string"), F.col("_s").cast("string"))
    return parts.withColumn("data_hash", F.sha2(text, 256)).drop("_x", "_s")


# --- checks over stored bars ------------------------------------------------------------------

def check_nulls(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in OHLCV])


def check_schema(bars: DataFrame, required: Sequence[str] = ("symbol", "timestamp", *OHLCV), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Missing columns are known from the schema; NULLs in present ones are counted."""
    missing = [c for c in required if c not in bars.columns]
    present = [c for c in required if c in bars.columns and c not in keys]
    nulls = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in present], F.lit(0))
    found = bars.groupBy(*keys).agg(nulls.alias("null_count"))
    return found.withColumns({"missing_columns": F.lit(len(missing)).cast("long"), "passed": (F.col("null_count") == 0) & F.lit(not missing)})


def ohlc_rules(close_positive: bool = True) -> list[tuple[str, Column]]:
    c = F.col
    rules = [
        ("high < open", c("high") < c("open")), ("high < close", c("high") < c("close")), ("low > open", c("low") > c("open")),
        ("low > close", c("low") > c("close")), ("high < low", c("high") < c("low")), ("volume < 0", c("volume") < 0),
        ("open <= 0", c("open") <= 0),
    ]
    return [*rules, ("close <= 0", c("close") <= 0)] if close_positive else rules


def check_ohlc(bars: DataFrame, close_positive: bool = True) -> DataFrame:
    return bars.withColumn("issues", codes(ohlc_rules(close_positive))).filter(F.size("issues") > 0)


def check_duplicates(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe", "timestamp")) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def check_future(bars: DataFrame, as_of: Column) -> DataFrame:
    return bars.filter(F.col("timestamp") > as_of)


def check_timestamp_integrity(bars: DataFrame, as_of: Column) -> DataFrame:
    """Future rows plus rows that do not advance past the one before (in timestamp order, i.e. repeats)."""
    future = bars.groupBy("symbol").agg(F.sum((F.col("timestamp") > as_of).cast("long")).alias("future_count"))
    repeats = bars.groupBy("symbol", "timestamp").agg((F.count(F.lit(1)) - 1).alias("_again")).groupBy("symbol").agg(
        F.sum("_again").alias("non_monotonic_count"))
    return future.join(repeats, "symbol").withColumn("issue_count", F.col("future_count") + F.col("non_monotonic_count"))


def _anomaly_frame(bars: DataFrame) -> Series:
    s = series(bars, "symbol", ("timestamp",), lookback=20)
    return s.with_columns({
        "vol_ma": F.avg("volume").over(s.rows(20)), "_seen": F.count("volume").over(s.rows(20)), "prev_close": F.lag("close").over(s.w)})


def _gap() -> Column:
    before = F.col("prev_close")
    jump = lambda c: F.abs(F.col(c) - before) / before > 0.20
    return F.coalesce((before > 0) & (jump("open") | jump("close")), F.lit(False))


def _spike(seen: Column) -> Column:
    return F.coalesce(seen & (F.col("volume") > 10 * F.col("vol_ma")) & (F.col("volume") > 1000), F.lit(False))


def check_anomalies(bars: DataFrame) -> DataFrame:
    """Volume above ten times its 20-row mean, or a gap above 20 %, from the fifth row on."""
    s = _anomaly_frame(bars)
    from_fifth = F.col(INDEX) >= 4
    rules = [("Volume spike", from_fifth & _spike(F.lit(True))), ("Price gap > 20%", from_fifth & _gap())]
    return s.with_columns({"issues": codes(rules)}).done().filter(F.size("issues") > 0).drop("_seen")


def check_anomalies_min5(bars: DataFrame) -> DataFrame:
    """Variant: symbols of at least 20 rows, the mean needs five observations, gaps are not gated."""
    s = _anomaly_frame(bars)
    long_enough = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 20").select("symbol")
    rules = [("Volume spike", _spike(F.col("_seen") >= 5)), ("Price gap > 20%", _gap())]
    found = s.with_columns({"issues": codes(rules)}).done().filter(F.size("issues") > 0).drop("_seen")
    return found.join(long_enough, "symbol", "left_semi")


def symbol_bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min(session_date()).alias("first"), F.max(session_date()).alias("last"))


def observed_days(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", session_date().alias("session_date")).distinct()


def check_missing_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions without a daily bar; special sessions are excused."""
    return missing_days(symbol_bounds(bars), observed_days(bars), calendar.filter("kind <> 'SPECIAL_SESSION'"))


def check_missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return missing_days(symbol_bounds(bars), observed_days(bars), calendar)


def expected_minutes(bounds: DataFrame, calendar: DataFrame, interruptions: DataFrame | None = None) -> DataFrame:
    """The minute grid of every symbol: session minutes between its first and last day."""
    grid = bounds.select("symbol", F.explode(F.sequence("first", "last")).alias("session_date")).join(
        calendar.select("session_date", "open_at", "close_at"), "session_date")
    last = F.col("close_at") - F.expr("INTERVAL '1' MINUTE")
    minutes = grid.select("symbol", "session_date", F.explode(F.sequence("open_at", last, F.expr("INTERVAL '1' MINUTE"))).alias("timestamp"))
    if interruptions is None:
        return minutes
    halted = interruptions.groupBy("session_date").agg(F.collect_set(F.struct("start_at", "end_at")).alias("_halts"))
    joined = minutes.join(halted, "session_date", "left")
    stopped = F.exists("_halts", lambda h: (h["start_at"] <= F.col("timestamp")) & (F.col("timestamp") < h["end_at"]))
    return joined.filter(~F.coalesce(stopped, F.lit(False))).drop("_halts")


def check_missing_bars(bars: DataFrame, calendar: DataFrame, interruptions: DataFrame | None = None) -> DataFrame:
    """Expected session minutes without a bar."""
    return expected_minutes(symbol_bounds(bars), calendar, interruptions).join(
        bars.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_anti")


def check_session_alignment(bars: DataFrame, calendar: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Bars on days without a session, or outside session hours for intraday bars."""
    from barlake.operators.calendar import session_flags

    flagged = session_flags(bars, calendar)
    ok = F.col("is_trading_day") if timeframe == "1d" else F.col("is_session_open")
    return flagged.filter(~ok)


def expected_interruptions(bars: DataFrame, overrides: DataFrame) -> DataFrame:
    """Declared interruptions inside each symbol's range."""
    stops = overrides.filter("kind = 'INTERRUPTION'").select("session_date", "open_time", "close_time")
    days = symbol_bounds(bars).select("symbol", F.explode(F.sequence("first", "last")).alias("session_date"))
    return days.join(stops, "session_date")


def quality_report(bars: DataFrame, calendar: DataFrame, as_of: Column, timeframe: str = "1d") -> DataFrame:
    """Long report: one row per symbol and check with its issue count, for all symbols at once.

    Row-local checks share one aggregation; the others are counted on their own small keys.
    """
    n = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in OHLCV])
    broken = reduce(lambda a, b: a | b, [test for _, test in ohlc_rules()])
    flat = bars.groupBy("symbol").agg(
        F.sum(nulls).alias("null_values"), n(broken).alias("ohlc_integrity"), n(F.col("timestamp") > as_of).alias("future_timestamps"))
    per_ts = bars.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("c")).groupBy("symbol").agg(
        n(F.col("c") > 1).alias("duplicates"), F.sum(F.col("c") - 1).alias("_again"))
    count = lambda df, name: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(name))
    wide = flat.join(per_ts, "symbol")
    missing = check_missing_days(bars, calendar) if timeframe == "1d" else check_missing_bars(bars, calendar)
    for frame, name in (
        (check_session_alignment(bars, calendar, timeframe), "session_alignment"), (check_missing_sessions(bars, calendar), "missing_sessions"),
        (missing, "missing_candles"), (check_anomalies(bars), "anomalies"),
    ):
        wide = wide.join(count(frame, name), "symbol", "left")
    wide = wide.na.fill(0).withColumns({
        "schema": F.col("null_values"), "timestamp_integrity": F.col("future_timestamps") + F.col("_again")})
    return wide.unpivot("symbol", list(CHECK_SEVERITY), "check_type", "issue_count").withColumn("timeframe", F.lit(timeframe))


def severity_of(check: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CHECK_SEVERITY.items() for x in kv])[check], F.lit("ERROR"))


def quality_severity(report: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Totals by severity, overall status, and whether an operator must be paged."""
    failed = F.coalesce(F.col("status") == "CHECK_FAILED", F.lit(False)) if "status" in report.columns else F.lit(False)
    df = report.withColumns({"_failed": failed, "_severity": F.when(failed, "CRITICAL").otherwise(severity_of(F.col("check_type")))})
    total = lambda level: F.sum(F.when(F.col("_severity") == level, F.col("issue_count")).otherwise(0))
    sums = df.groupBy(*keys).agg(
        total("CRITICAL").alias("critical_count"), total("ERROR").alias("error_count"), total("WARNING").alias("warning_count"),
        F.max("_failed").alias("has_check_failure"))
    critical = (F.col("critical_count") > 0) | F.col("has_check_failure")
    status = F.when(critical, "CRITICAL").when(F.col("error_count") > 0, "ERROR").when(F.col("warning_count") > 0, "WARNING").otherwise("HEALTHY")
    return sums.withColumns({
        "status": status, "passed": ~critical & (F.col("error_count") == 0),
        "blocking_issue_count": F.col("critical_count") + F.col("error_count"), "page_operator": critical})


def certify_datasets(report: DataFrame, key: str = "symbol") -> DataFrame:
    """CERTIFIED when the six required checks are all zero and the report passed."""
    required = F.col("check_type").isin(*REQUIRED_CHECKS)
    six = report.filter(required).groupBy(key).agg(
        F.sum("issue_count").alias("issue_count"), F.count_distinct("check_type").alias("check_count"))
    passed = quality_severity(report, (key,)).select(key, "passed")
    ok = (F.col("issue_count") == 0) & (F.col("check_count") == len(REQUIRED_CHECKS)) & F.col("passed")
    return six.join(passed, key).withColumn("status", F.when(ok, "CERTIFIED").otherwise("FAILED"))


def require_certified(datasets: DataFrame, certificates: DataFrame, checks: DataFrame, required: Sequence[str] = REQUIRED_CHECKS) -> DataFrame:
    """Every dataset with ``blocker``: NULL when it is verified, promoted and certified with six zero checks."""
    latest = certificates.groupBy("dataset_id").agg(
        F.max_by(F.struct("certification_id", "status", "issue_count"), "completed_at").alias("c"))
    zero = checks.filter("issue_count = 0").groupBy("certification_id").agg(F.collect_set("check_type").alias("_zero"))
    df = datasets.join(latest, "dataset_id", "left").withColumn("certification_id", F.col("c.certification_id"))
    df = df.join(zero, "certification_id", "left")
    lacking = F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.coalesce("_zero", F.array().cast("array<string>"))))
    blocker = (
        F.when((F.col("status") != "VERIFIED") | (F.col("lifecycle_status") != "CANONICAL_PROMOTED"), "NOT_PROMOTED")
        .when(F.col("c").isNull(), "NO_CERTIFICATION")
        .when((F.col("c.status") != "CERTIFIED") | (F.col("c.issue_count") > 0), "NOT_CERTIFIED")
        .when(lacking > 0, "INCOMPLETE_CHECKS")
    )
    return df.select("dataset_id", "certification_id", blocker.alias("blocker"))


def certified_bars(bars: DataFrame, verdicts: DataFrame) -> DataFrame:
    return bars.join(verdicts.filter("blocker IS NULL"), "dataset_id", "left_semi")


def frame_checks(bars: DataFrame) -> DataFrame:
    """Composed frame: repeated timestamps and broken prices, one row per symbol."""
    broken = reduce(lambda a, b: a | b, [test for _, test in ohlc_rules()])
    per_ts = bars.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.coalesce(broken, F.lit(False)).cast("long")).alias("b"))
    out = per_ts.groupBy("symbol").agg(F.sum(F.col("c") - 1).alias("duplicate_rows"), F.sum("b").alias("ohlc_violations"))
    return out.withColumns({"monotonic": F.col("duplicate_rows") == 0, "passed": (F.col("duplicate_rows") == 0) & (F.col("ohlc_violations") == 0)})


def integrity_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Reference checks between stored tables, one row per check with its count."""
    t = tables
    orphans = {
        "ORPHAN_FILLS": t["fills"].join(t["orders"], "order_id", "left_anti"),
        "ORPHAN_COST_ROWS": t["costs"].join(t["fills"], "fill_id", "left_anti"),
        "BROKEN_DATASET_LINEAGE": t["bars"].filter("dataset_id IS NOT NULL").join(t["datasets"], "dataset_id", "left_anti"),
        "BLANK_MEMBERS": t["members"].filter("symbol IS NULL OR trim(symbol) = ''"),
        "QUARANTINE_WITHOUT_ISSUES": t["quarantined"].join(t["issues"], "dataset_id", "left_anti"),
        "SESSIONS_WITHOUT_RUNS": t["paper_sessions"].join(t["runs"], "run_id", "left_anti"),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("issue_count")).select(F.lit(name).alias("check_type"), "issue_count") for name, df in orphans.items()]
    return reduce(DataFrame.unionByName, rows)


def systemic_gaps(quality: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Dates missing for many symbols at once, from the gap lists of each symbol's latest report."""
    latest = quality.groupBy("symbol").agg(F.max_by("details", "checked_at").alias("details"))
    gaps = latest.select("symbol", F.explode(F.from_json("details", "gaps array<string>")["gaps"]).alias("gap_date"))
    symbols = quality.agg(F.count_distinct("symbol").alias("_n"))
    counts = gaps.groupBy("gap_date").agg(F.count_distinct("symbol").alias("symbols"))
    need = F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(fraction)))
    one = symbols.withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(one, "_one").filter(F.col("symbols") >= need).select("gap_date", "symbols")


def resolve_stranded(datasets: DataFrame, raw: DataFrame) -> DataFrame:
    """Datasets left in RAW_RECORDED: replayable when they have rows, else to be rejected."""
    stuck = datasets.filter("lifecycle_status = 'RAW_RECORDED'").select("dataset_id")
    sizes = raw.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))
    out = stuck.join(sizes, "dataset_id", "left").na.fill(0, ["rows"])
    return out.withColumn("action", F.when(F.col("rows") > 0, "REPLAY").otherwise("REJECT_EMPTY"))


def frame_certificate(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: content hash, contributing datasets, row count and basis.

    Dataset ids are made distinct before they are gathered; their number is the number of
    source files, not of rows.
    """
    one = frame.withColumn("_one", F.lit(1))
    digest = dataset_hash(one, ["_one"], columns)
    ids = one.filter("dataset_id IS NOT NULL").select("_one", "dataset_id").distinct().groupBy("_one").agg(
        F.sort_array(F.collect_list("dataset_id")).alias("dataset_ids"))
    basis = one.groupBy("_one").agg(F.array_join(F.sort_array(F.collect_set("adjustment")), "+").alias("basis"))
    return digest.join(ids, "_one", "left").join(basis, "_one").drop("_one")
