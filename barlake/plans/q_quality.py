"""Scan, sink, intake and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake import schemas
from barlake.operators import calendar as cal
from barlake.operators import features as f
from barlake.operators import quality as q
from barlake.plans import fixtures as fx
from barlake.plans import q_features as qf
from barlake.plans.registry import add
from barlake.sources import bars as src
from barlake.sources import tables as tb

W, rows = qf.W, qf.rows
BAR = "open high low close volume"


def ts(text: str):
    return F.lit(text).cast("timestamp")


def sessions(s, d):
    return cal.sessions(*fx.calendar_inputs(s, d))


# --- sources and sinks -----------------------------------------------------------------------
add("io01_read_bars", lambda s, d: src.select_bars(fx.bars(s, d), "1d", ["NATION_1", "NATION_2", "NATION_20"]),
    f"SELECT symbol, day, {', '.join(BAR.split())} FROM bars WHERE symbol IN ('NATION_1', 'NATION_2', 'NATION_20')", "symbol day", BAR)
add("io02_read_bars_range", lambda s, d: src.read_bars_range(fx.bars(s, d), ts("1997-01-01"), ts("1998-12-31"), "UNADJUSTED"),
    "SELECT symbol, day, close FROM bars WHERE timestamp BETWEEN '1997-01-01' AND '1998-12-31'", "symbol day", "close")
add("io02_range_problems",
    lambda s, d: src.range_problems(fx.bars(s, d).filter("symbol <> 'NATION_20' OR timestamp > '1997-02-01'"), ts("1997-01-01"), ts("1998-12-31")),
    """SELECT symbol, 'COVERAGE_STARTS_LATE' AS problem FROM (SELECT symbol, min(timestamp) AS a FROM bars WHERE timestamp BETWEEN '1997-01-01' AND '1998-12-31'
    AND (symbol <> 'NATION_20' OR timestamp > '1997-02-01') GROUP BY 1) WHERE a > TIMESTAMP '1997-01-08'
    UNION ALL SELECT symbol, 'COVERAGE_ENDS_EARLY' FROM (SELECT symbol, max(timestamp) AS a FROM bars WHERE timestamp BETWEEN '1997-01-01' AND '1998-12-31' GROUP BY 1)
    WHERE a < TIMESTAMP '1998-12-24'""", "symbol problem")
add("io03_uniqueness", lambda s, d: src.uniqueness(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "SELECT sum(c) AS rows, count(*) AS unique_keys FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)", "", "rows unique_keys")


def raw_json(s, d):
    raw = fx.raw_bars(s, d)
    half = F.col("source_row_number") % 2 == 0
    body = F.to_json(F.struct(*[c for c in ("timestamp", "open", "high", "low", "close", "volume")]))
    return raw.withColumn("raw_json", F.when(half, body)).withColumn("open", F.when(half, "zzz").otherwise(F.col("open")))


add("io05_parse_raw_rows", lambda s, d: src.parse_raw_rows(raw_json(s, d)).withColumn("close", F.when(~F.isnan("close"), F.col("close"))),
    """SELECT dataset_id, source_row_number, try_cast(open AS DOUBLE) AS open, try_cast(high AS DOUBLE) AS high, CASE WHEN close <> 'NaN' THEN try_cast(close AS DOUBLE) END AS close,
    try_cast(volume AS DOUBLE) AS volume FROM raw_bars""", "dataset_id source_row_number", "open high close volume")
add("io06_archive_selection", lambda s, d: fx.bars(s, d).filter(F.col("timestamp") < ts("1998-01-01")).groupBy("timeframe", F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows")),
    "SELECT timeframe, strftime(timestamp, '%Y-%m') AS month, count(*) AS rows FROM bars WHERE timestamp < '1998-01-01' GROUP BY 1, 2", "timeframe month", "rows")


def split_bars(s, d):
    b = fx.bars(s, d)
    return b.filter("dayofmonth(timestamp) <= 20"), b.filter("dayofmonth(timestamp) >= 10").withColumn("close", F.col("close") * 2)


add("io07_upsert_ignore", lambda s, d: tb.upsert_ignore(*split_bars(s, d), ["symbol", "timestamp"]),
    "SELECT symbol, day, close * 2 AS close FROM bars WHERE day(d) > 20", "symbol day", "close")
add("io08_upsert_replace",
    lambda s, d: (lambda t, n: tb.upsert_replace(t.withColumn("version", F.lit(1)), n.withColumn("version", F.lit(2)), ["symbol", "timestamp"], "version"))(*split_bars(s, d)),
    "SELECT symbol, day, close * CASE WHEN day(d) >= 10 THEN 2 ELSE 1 END AS close FROM bars", "symbol day", "close")


def provenance(s, d):
    target = fx.bars(s, d).withColumn("provider_name", F.when(F.dayofmonth("timestamp") < 15, "first")).withColumn("dataset_id", F.lit(None).cast("string"))
    new = fx.bars(s, d).withColumn("close", F.when(F.dayofmonth("timestamp") == 20, F.col("close") + 1).otherwise(F.col("close")))
    new = new.withColumn("provider_name", F.lit("second")).withColumn("dataset_id", F.concat(F.lit("ds-"), F.col("symbol")))
    return tb.merge_provenance(target, new, ["symbol", "timestamp"])


add("io09_merge_provenance", provenance,
    """SELECT symbol, day, CASE WHEN day(d) < 15 THEN 'first' WHEN day(d) <> 20 THEN 'second' END AS provider_name,
    CASE WHEN day(d) <> 20 THEN 'ds-' || symbol END AS dataset_id FROM bars""", "symbol day provider_name dataset_id")
add("io10_conform", lambda s, d: schemas.conform(fx.bars(s, d), schemas.BARS),
    "SELECT symbol, day, timeframe, adjustment, NULL::VARCHAR AS provider_name, close, volume FROM bars", "symbol day timeframe adjustment provider_name", "close volume")
LONG = ["return_1", "range_pct", "sma_short", "sma_long", "atr"]
add("io11_features_long",
    lambda s, d: tb.features_long(f.build_features(fx.bars(s, d), ema=False).select("symbol", "timestamp", *LONG), "core"),
    " UNION ALL ".join(f"SELECT symbol, day, '{c}' AS feature_name, 'core' AS feature_group, {c} AS feature_value FROM feats WHERE {c} IS NOT NULL" for c in LONG),
    "symbol day feature_name feature_group", "feature_value", **qf.VIEWS)
add("io12_storeable_features", lambda s, d: tb.storeable_features(f.build_features(fx.bars(s, d), ema=False)),
    "SELECT symbol, day, return_1, volume_zscore FROM feats", "symbol day", "return_1 volume_zscore", **qf.VIEWS)
add("io13_flatten_quality",
    lambda s, d: tb.flatten_quality(q.check_nulls(fx.bars(s, d).withColumn("high", F.when(F.dayofmonth("timestamp") > 3, F.col("high"))), ["symbol", "timeframe"]), ["open_nulls", "high_nulls"]),
    """SELECT symbol, '1d' AS timeframe, 'open_nulls' AS check_type, 0 AS issue_count FROM bars GROUP BY 1
    UNION ALL SELECT symbol, '1d', 'high_nulls', sum(CAST(day(d) <= 3 AS BIGINT)) FROM bars GROUP BY 1""", "symbol timeframe check_type", "issue_count")

# --- cleaning and validation -------------------------------------------------------------------
TYPED = """SELECT * FROM (SELECT dataset_id, symbol, source_row_number, try_cast(timestamp AS TIMESTAMP) AS t, try_cast(open AS DOUBLE) AS open, try_cast(high AS DOUBLE) AS high,
 try_cast(low AS DOUBLE) AS low, try_cast(close AS DOUBLE) AS close, try_cast(volume AS DOUBLE) AS volume FROM raw_bars)
 WHERE t IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) AND volume IS NOT NULL"""
SANE = "volume >= 0 AND open > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND high >= low"
TV = {"typed": TYPED}
add("q01_clean_bars", lambda s, d: q.clean_bars(fx.raw_bars(s, d)),
    f"SELECT symbol, strftime(t, '%Y-%m-%d') AS day, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY source_row_number) AS rn FROM typed WHERE {SANE}) WHERE rn = 1",
    "symbol day", BAR, **TV)
add("q02_snapshot_bars", lambda s, d: q.snapshot_bars(fx.raw_bars(s, d)),
    f"SELECT symbol, strftime(t, '%Y-%m-%d') AS day, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY source_row_number) AS rn FROM typed) WHERE rn = 1 AND {SANE} AND close > 0",
    "symbol day", BAR, **TV)
PARSED = """SELECT *, try_cast(nullif(timestamp, '') AS TIMESTAMP) AS t, try_cast(open AS DOUBLE) AS o, try_cast(high AS DOUBLE) AS h, try_cast(low AS DOUBLE) AS l, try_cast(close AS DOUBLE) AS c,
 try_cast(volume AS DOUBLE) AS v FROM raw_bars"""
FIRSTS = "SELECT *, min(source_row_number) OVER (PARTITION BY dataset_id, t) AS first_row, o IS NOT NULL AND c IS NOT NULL AND isfinite(o) AND isfinite(c) AND h IS NOT NULL AND l IS NOT NULL AND v IS NOT NULL AS good FROM parsed"
ISSUES = " UNION ALL ".join(f"SELECT dataset_id, source_row_number, '{code}' AS reason_code FROM firsts WHERE {test}" for code, test in [
    ("TIMESTAMP_MISSING", "timestamp = ''"), ("TIMESTAMP_DUPLICATE", "t IS NOT NULL AND source_row_number > first_row"),
    ("CLOSE_NON_FINITE", "c IS NOT NULL AND NOT isfinite(c)"), ("NUMERIC_PARSE_FAILED", "o IS NULL"), ("VOLUME_NEGATIVE", "good AND v < 0"),
    ("LOW_NON_POSITIVE", "good AND l <= 0"), ("HIGH_NON_POSITIVE", "good AND h <= 0"),
    ("HIGH_BELOW_OPEN", "good AND h < o"), ("HIGH_BELOW_CLOSE", "good AND h < c"), ("LOW_ABOVE_OPEN", "good AND l > o"), ("LOW_ABOVE_CLOSE", "good AND l > c"), ("HIGH_BELOW_LOW", "good AND h < l")])
IV = {"parsed": PARSED, "firsts": FIRSTS, "issues": ISSUES}
add("q03_validate_raw", lambda s, d: q.validate_raw(fx.raw_bars(s, d)), "SELECT * FROM issues", "dataset_id source_row_number reason_code", **IV)


CLEAN_ROW = "source_row_number < 1000000 AND " + " AND ".join(f"source_row_number % {m} <> 0" for m in (73, 79, 83, 89, 97))


def sorted_out(s, d):
    """All raw bars; a third of the symbols keep their planted defects in a dataset of their own."""
    apart = F.expr(f"substring_index(symbol, '_', -1) % 3 = 0 AND NOT ({CLEAN_ROW})")
    return fx.raw_bars(s, d).withColumn("dataset_id", F.when(apart, F.concat("dataset_id", F.lit("-defects"))).otherwise(F.col("dataset_id")))


def split(part: int):
    def build(s, d):
        raw = sorted_out(s, d)
        return q.quarantine_split(raw, q.validate_raw(raw))[part].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))
    return build


SORTED = f"SELECT * REPLACE (CASE WHEN CAST(split_part(symbol, '_', 2) AS INT) % 3 = 0 AND NOT ({CLEAN_ROW}) THEN dataset_id || '-defects' ELSE dataset_id END AS dataset_id) FROM raw_bars"
SV = {"sorted_bars": SORTED, **IV, "parsed": PARSED.replace("FROM raw_bars", "FROM sorted_bars")}
add("q04_quarantine_valid", split(0), "SELECT dataset_id, count(*) AS rows FROM sorted_bars WHERE dataset_id NOT IN (SELECT dataset_id FROM issues) GROUP BY 1", "dataset_id", "rows", **SV)
add("q04_quarantine_held", split(1), "SELECT dataset_id, count(*) AS rows FROM sorted_bars WHERE dataset_id IN (SELECT dataset_id FROM issues) GROUP BY 1", "dataset_id", "rows", **SV)
add("q05_dataset_hash", lambda s, d: q.dataset_hash(fx.bars(s, d), ["symbol"], ["timestamp", "open", "high", "low", "close", "volume"]), None, "symbol rows data_hash")


def hash_changes(s, d):
    """Hashes of the bars against those of a copy in another order, and of one whose lowest closes moved."""
    columns = ["timestamp", "open", "high", "low", "close", "volume"]
    bars = fx.bars(s, d)
    hashes = lambda df, name: q.dataset_hash(df, ["symbol"], columns).select("symbol", "rows", F.col("data_hash").alias(name))
    moved = bars.withColumn("close", F.when((F.col("symbol") == "NATION_3") & (F.dayofmonth("timestamp") == 13), F.col("close") + 1e-9).otherwise(F.col("close")))
    copy = bars.repartition("timestamp").sortWithinPartitions(F.desc("timestamp"))
    joined = hashes(bars, "a").join(hashes(copy, "b").drop("rows"), "symbol").join(hashes(moved, "c").drop("rows"), "symbol")
    return joined.select("symbol", "rows", (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("changed"))


add("q05_hash_changes", hash_changes, "SELECT symbol, count(*) AS rows, true AS same_in_any_order, symbol = 'NATION_3' AND count(*) FILTER (day(d) = 13) > 0 AS changed FROM bars GROUP BY 1",
    "symbol same_in_any_order changed", "rows")
add("q06_localize_ts",
    lambda s, d: q.localize_ts(fx.table(s, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz")), "t").groupBy(F.date_format("t", "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count(F.lit(1)).alias("rows")),
    "SELECT strftime(o_orderdate - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS minute, count(*) AS rows FROM orders GROUP BY 1", "minute", "rows")
add("q09_check_nulls", lambda s, d: q.check_nulls(fx.bars(s, d).withColumn("close", F.when(F.dayofmonth("timestamp") != 7, F.col("close")))),
    "SELECT symbol, 0 AS open_nulls, sum(CAST(day(d) = 7 AS BIGINT)) AS close_nulls FROM bars GROUP BY 1", "symbol", "open_nulls close_nulls")
add("q10_check_schema", lambda s, d: q.check_schema(fx.bars(s, d).withColumn("close", F.when(F.dayofmonth("timestamp") != 7, F.col("close"))).drop("volume")),
    "SELECT symbol, sum(CAST(day(d) = 7 AS BIGINT)) AS null_count, 1 AS missing_columns, false AS passed FROM bars GROUP BY 1", "symbol passed", "null_count missing_columns")


def broken(s, d):
    """Bars with defects by calendar day, and a second copy of some rows."""
    b = fx.bars(s, d)
    day = F.dayofmonth("timestamp")
    b = b.withColumns({"high": F.when(day == 9, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(day == 11, -F.col("volume")).otherwise(F.col("volume")),
                       "close": F.when(day == 13, F.lit(0.0)).otherwise(F.col("close"))})
    return b.unionByName(b.filter("dayofmonth(timestamp) = 17"))


BROKEN = """SELECT * FROM brk UNION ALL SELECT * FROM brk WHERE day(d) = 17"""
BRK = """SELECT * REPLACE (CASE WHEN day(d) = 9 THEN low - 1 ELSE high END AS high, CASE WHEN day(d) = 11 THEN -volume ELSE volume END AS volume,
 CASE WHEN day(d) = 13 THEN 0.0 ELSE close END AS close) FROM bars"""
BV = {"brk": BRK, "broken": BROKEN}
RULES = [("high < open", "high < open"), ("high < close", "high < close"), ("low > open", "low > open"), ("low > close", "low > close"), ("high < low", "high < low"),
         ("volume < 0", "volume < 0"), ("open <= 0", "open <= 0"), ("close <= 0", "close <= 0")]
ANY = " OR ".join(t for _, t in RULES)
add("q11_check_ohlc", lambda s, d: q.check_ohlc(broken(s, d)).withColumn("issues", F.array_join("issues", ",")),
    f"SELECT symbol, day, concat_ws(',', {', '.join(f'CASE WHEN {t} THEN ' + repr(n) + ' END' for n, t in RULES)}) AS issues FROM broken WHERE {ANY}", "symbol day issues", **BV)
add("q12_check_duplicates", lambda s, d: q.check_duplicates(broken(s, d)), "SELECT symbol, day, count(*) AS copies FROM broken GROUP BY 1, 2 HAVING count(*) > 1", "symbol day", "copies", **BV)
add("q13_check_future", lambda s, d: q.check_future(fx.bars(s, d), ts("2000-06-01")), "SELECT symbol, day FROM bars WHERE timestamp > '2000-06-01'", "symbol day")
add("q14_check_timestamp_integrity", lambda s, d: q.check_timestamp_integrity(broken(s, d), ts("2000-06-01")),
    """SELECT symbol, sum(CAST(timestamp > '2000-06-01' AS BIGINT)) AS future_count, sum(CAST(coalesce(timestamp <= prev, false) AS BIGINT)) AS non_monotonic_count FROM
    (SELECT symbol, timestamp, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev FROM broken) GROUP BY 1""", "symbol", "future_count non_monotonic_count", **BV)
SPIKED = "SELECT * REPLACE (CASE WHEN day(d) = 20 THEN volume * 100 ELSE volume END AS volume) FROM bars"
ANOM = f"SELECT *, avg(volume) {rows(20)} AS vol_ma, count(volume) {rows(20)} AS seen, lag(close) {W} AS pc, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM spiked"
SV = {"spiked": SPIKED, "anom": ANOM}
GAP = "pc > 0 AND (abs(open - pc) / pc > 0.20 OR abs(close - pc) / pc > 0.20)"


def spiked(s, d):
    return fx.bars(s, d).withColumn("volume", F.when(F.dayofmonth("timestamp") == 20, F.col("volume") * 100).otherwise(F.col("volume")))


add("q15_check_anomalies", lambda s, d: q.check_anomalies(spiked(s, d)).withColumn("issues", F.array_join("issues", ",")),
    f"""SELECT symbol, day, concat_ws(',', CASE WHEN volume > 10 * vol_ma AND volume > 1000 THEN 'Volume spike' END, CASE WHEN {GAP} THEN 'Price gap > 20%' END) AS issues
    FROM anom WHERE rn >= 5 AND ((volume > 10 * vol_ma AND volume > 1000) OR ({GAP}))""", "symbol day issues", **SV)
add("q15b_check_anomalies_min5", lambda s, d: q.check_anomalies_min5(spiked(s, d)).withColumn("issues", F.array_join("issues", ",")),
    f"""SELECT symbol, day, concat_ws(',', CASE WHEN seen >= 5 AND volume > 10 * vol_ma AND volume > 1000 THEN 'Volume spike' END, CASE WHEN {GAP} THEN 'Price gap > 20%' END) AS issues
    FROM anom WHERE total >= 20 AND ((seen >= 5 AND volume > 10 * vol_ma AND volume > 1000) OR ({GAP}))""", "symbol day issues", **SV)


def minute_bars(s, d):
    """One bar per minute that traded, on a common clock: event times folded into session hours."""
    e = fx.table(s, d, "events")
    minute = F.timestamp_seconds(F.floor(F.col("ts").cast("timestamp").cast("long") / 60) * 60)
    return e.select(F.col("event_type").alias("symbol"), minute.alias("timestamp")).distinct()


MINUTES = "SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL 1 MINUTE, ts) AS timestamp FROM events"
MCAL = """SELECT dd::DATE AS session_date, dd + INTERVAL 225 MINUTE AS open_at, dd + INTERVAL 600 MINUTE AS close_at FROM (
 SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 1, INTERVAL 1 DAY)) AS dd FROM events) WHERE isodow(dd) <= 5"""
EDGE = "SELECT symbol, min((timestamp + INTERVAL 330 MINUTE)::DATE) AS a, max((timestamp + INTERVAL 330 MINUTE)::DATE) AS b FROM minutes GROUP BY 1"


def event_sessions(s, d):
    e = fx.table(s, d, "events")
    bounds = e.agg(F.to_date(F.min("ts")).alias("start"), F.date_add(F.max("ts"), 1).alias("end"))
    none = s.createDataFrame([], "session_date date, kind string, open_time string, close_time string")
    return cal.sessions(bounds, none)


add("q16_check_missing_bars",
    lambda s, d: q.check_missing_bars(minute_bars(s, d), event_sessions(s, d)).groupBy("symbol", F.date_format("session_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("missing")),
    """SELECT symbol, strftime(session_date, '%Y-%m-%d') AS day, count(*) AS missing FROM (
    SELECT e.symbol, c.session_date, unnest(generate_series(open_at, close_at - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t FROM edges e JOIN mcal c ON c.session_date BETWEEN e.a AND e.b) g
    WHERE NOT EXISTS (SELECT 1 FROM minutes m WHERE m.symbol = g.symbol AND m.timestamp = g.t) GROUP BY 1, 2""", "symbol day", "missing", minutes=MINUTES, mcal=MCAL, edges=EDGE)
BOUND = "SELECT symbol, min(d) AS a, max(d) AS b FROM bars GROUP BY 1"
MISSING = """SELECT e.symbol, s.day FROM bounds e JOIN sessions s ON s.session_date BETWEEN e.a AND e.b WHERE {kind}
 NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = e.symbol AND b.d = s.session_date)"""


def dayed(df):
    return df.withColumn("day", F.date_format("session_date", "yyyy-MM-dd"))


add("q17_check_missing_days", lambda s, d: dayed(q.check_missing_days(fx.bars(s, d), sessions(s, d))),
    MISSING.format(kind="s.kind <> 'SPECIAL_SESSION' AND"), "symbol day", bounds=BOUND)
add("q18_check_session_alignment", lambda s, d: q.check_session_alignment(fx.bars(s, d), sessions(s, d)),
    "SELECT symbol, day FROM bars WHERE d NOT IN (SELECT session_date FROM sessions)", "symbol day")
add("q18_check_missing_sessions", lambda s, d: dayed(q.check_missing_sessions(fx.bars(s, d), sessions(s, d))), MISSING.format(kind=""), "symbol day", bounds=BOUND)
add("q18_intraday_alignment", lambda s, d: q.check_session_alignment(minute_bars(s, d), event_sessions(s, d), "1m").withColumn("minute", F.date_format("timestamp", "yyyy-MM-dd HH:mm")),
    """SELECT symbol, strftime(timestamp, '%Y-%m-%d %H:%M') AS minute FROM minutes m WHERE NOT EXISTS (SELECT 1 FROM mcal c
    WHERE c.session_date = (m.timestamp + INTERVAL 330 MINUTE)::DATE AND m.timestamp BETWEEN open_at AND close_at)""", "symbol minute", minutes=MINUTES, mcal=MCAL)
ANOM_B = f"SELECT symbol FROM (SELECT *, avg(volume) {rows(20)} AS vol_ma, lag(close) {W} AS pc, row_number() {W} AS rn FROM bars) WHERE rn >= 5 AND ((volume > 10 * vol_ma AND volume > 1000) OR ({GAP}))"
COUNTS = f"""SELECT symbol, 'missing_candles' AS check_type, count(*) AS n FROM ({MISSING.format(kind="s.kind <> 'SPECIAL_SESSION' AND")}) GROUP BY 1
 UNION ALL SELECT symbol, 'missing_sessions', count(*) FROM ({MISSING.format(kind='')}) GROUP BY 1
 UNION ALL SELECT symbol, 'session_alignment', count(*) FROM bars WHERE d NOT IN (SELECT session_date FROM sessions) GROUP BY 1
 UNION ALL SELECT symbol, 'future_timestamps', count(*) FROM bars WHERE timestamp > '2001-06-01' GROUP BY 1
 UNION ALL SELECT symbol, 'timestamp_integrity', count(*) FROM bars WHERE timestamp > '2001-06-01' GROUP BY 1
 UNION ALL SELECT symbol, 'anomalies', count(*) FROM ({ANOM_B}) GROUP BY 1"""
CHECKS = ", ".join(f"('{c}')" for c in q.CHECK_SEVERITY)
REPORT = f"SELECT s.symbol, '1d' AS timeframe, c.check_type, coalesce(n, 0) AS issue_count FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (VALUES {CHECKS}) c(check_type) LEFT JOIN counts ON counts.symbol = s.symbol AND counts.check_type = c.check_type"
RV = {"bounds": BOUND, "counts": COUNTS, "report": REPORT}


def report(s, d):
    return q.quality_report(fx.bars(s, d), sessions(s, d), ts("2001-06-01"))


add("q19_quality_report", report, "SELECT * FROM report", "symbol timeframe check_type", "issue_count", **RV)
SEV = "CASE " + " ".join(f"WHEN check_type = '{k}' THEN '{v}'" for k, v in q.CHECK_SEVERITY.items()) + " END"
SEVERE = f"""SELECT symbol, timeframe, sum(CASE WHEN {SEV} = 'CRITICAL' THEN issue_count ELSE 0 END) AS critical_count, sum(CASE WHEN {SEV} = 'ERROR' THEN issue_count ELSE 0 END) AS error_count,
 sum(CASE WHEN {SEV} = 'WARNING' THEN issue_count ELSE 0 END) AS warning_count FROM mixed_report GROUP BY 1, 2"""
# Symbol number decides which severities remain, so that every status occurs.
NUM = "CAST(split_part(symbol, '_', 2) AS INT)"
MIXED = f"SELECT symbol, timeframe, check_type, CASE WHEN {NUM} % 4 >= 1 AND {SEV} = 'CRITICAL' THEN 0 WHEN {NUM} % 4 >= 2 AND {SEV} = 'ERROR' THEN 0 WHEN {NUM} % 4 = 3 THEN 0 ELSE issue_count END AS issue_count FROM report"


def mixed(s, d):
    r = report(s, d).withColumn("_n", F.substring_index("symbol", "_", -1).cast("int") % 4).withColumn("_s", q.severity_of(F.col("check_type")))
    zero = ((F.col("_n") >= 1) & (F.col("_s") == "CRITICAL")) | ((F.col("_n") >= 2) & (F.col("_s") == "ERROR")) | (F.col("_n") == 3)
    return r.withColumn("issue_count", F.when(zero, 0).otherwise(F.col("issue_count"))).drop("_n", "_s")


add("q20_quality_severity", lambda s, d: q.quality_severity(mixed(s, d)),
    """SELECT symbol, timeframe, critical_count, error_count, warning_count, critical_count + error_count AS blocking_issue_count,
    CASE WHEN critical_count > 0 THEN 'CRITICAL' WHEN error_count > 0 THEN 'ERROR' WHEN warning_count > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
    critical_count + error_count = 0 AS passed, critical_count > 0 AS page_operator FROM severe""",
    "symbol timeframe status passed page_operator", "critical_count error_count warning_count blocking_issue_count", mixed_report=MIXED, severe=SEVERE, **RV)
REQ = ", ".join(f"'{c}'" for c in q.REQUIRED_CHECKS)
add("q21_certify_datasets", lambda s, d: q.certify_datasets(mixed(s, d)),
    f"""SELECT m.symbol, sum(issue_count) AS issue_count, CASE WHEN sum(issue_count) = 0 AND max(critical_count + error_count) = 0 THEN 'CERTIFIED' ELSE 'FAILED' END AS status
    FROM mixed_report m JOIN severe USING (symbol) WHERE check_type IN ({REQ}) GROUP BY 1""", "symbol status", "issue_count", mixed_report=MIXED, severe=SEVERE, **RV)


def datasets(s, d):
    """One dataset per symbol with a lifecycle by symbol number."""
    n = F.substring_index("symbol", "_", -1).cast("int")
    return fx.bars(s, d).select("symbol").distinct().select(
        "symbol", F.concat(F.lit("ds-"), F.col("symbol")).alias("dataset_id"),
        F.when(n % 5 == 4, "PENDING").otherwise("VERIFIED").alias("status"),
        F.when(n % 7 == 6, "RAW_RECORDED").otherwise("CANONICAL_PROMOTED").alias("lifecycle_status"))


def certificates(s, d):
    c = q.certify_datasets(mixed(s, d))
    owner = F.when(F.substring_index("symbol", "_", -1).cast("int") % 8 == 7, "other-").otherwise("ds-")
    return c.select(F.concat(owner, F.col("symbol")).alias("dataset_id"), F.concat(F.lit("cert-"), F.col("symbol")).alias("certification_id"),
                    "status", "issue_count", F.current_timestamp().alias("completed_at"))


def child_checks(s, d):
    kind = F.expr("CASE WHEN check_type = 'schema' AND substring_index(symbol, '_', -1) % 6 = 3 THEN 'other' ELSE check_type END")
    return mixed(s, d).select(F.concat(F.lit("cert-"), F.col("symbol")).alias("certification_id"), kind.alias("check_type"), "issue_count")


DS = f"SELECT symbol, 'ds-' || symbol AS dataset_id, CASE WHEN {NUM} % 5 = 4 THEN 'PENDING' ELSE 'VERIFIED' END AS status, CASE WHEN {NUM} % 7 = 6 THEN 'RAW_RECORDED' ELSE 'CANONICAL_PROMOTED' END AS lifecycle_status FROM (SELECT DISTINCT symbol FROM bars)"
add("q22_require_certified", lambda s, d: q.require_certified(datasets(s, d), certificates(s, d), child_checks(s, d)),
    f"""SELECT ds.dataset_id, CASE WHEN ds.status <> 'VERIFIED' OR lifecycle_status <> 'CANONICAL_PROMOTED' THEN 'NOT_PROMOTED' WHEN {NUM.replace('symbol', 'ds.symbol')} % 8 = 7 THEN 'NO_CERTIFICATION'
    WHEN c.status <> 'CERTIFIED' THEN 'NOT_CERTIFIED' WHEN {NUM.replace('symbol', 'ds.symbol')} % 6 = 3 THEN 'INCOMPLETE_CHECKS' END AS blocker
    FROM ds JOIN (SELECT m.symbol, CASE WHEN sum(issue_count) = 0 AND max(critical_count + error_count) = 0 THEN 'CERTIFIED' ELSE 'FAILED' END AS status
    FROM mixed_report m JOIN severe USING (symbol) WHERE check_type IN ({REQ}) GROUP BY 1) c ON c.symbol = ds.symbol""", "dataset_id blocker",
    mixed_report=MIXED, severe=SEVERE, ds=DS, **RV)
add("q23_frame_checks", lambda s, d: q.frame_checks(broken(s, d)),
    f"SELECT symbol, count(*) - count(DISTINCT timestamp) AS duplicate_rows, sum(CAST({ANY} AS BIGINT)) AS ohlc_violations, count(*) = count(DISTINCT timestamp) AS monotonic FROM broken GROUP BY 1",
    "symbol monotonic", "duplicate_rows ohlc_violations", **BV)


def tables(s, d):
    f_ = fx.fills(s, d).select("order_id", F.xxhash64("run_id", "order_id").alias("fill_id"))
    return {
        "fills": f_, "orders": fx.table(s, d, "orders").select(F.expr("CASE WHEN o_orderkey % 50 = 0 THEN -1 - o_orderkey ELSE o_orderkey END").alias("order_id")),
        "costs": f_.select(F.when(F.col("order_id") % 20 == 0, -F.col("order_id")).otherwise(F.col("fill_id")).alias("fill_id")),
        "bars": fx.bars(s, d).select(F.concat(F.lit("ds-"), F.col("symbol")).alias("dataset_id")), "datasets": datasets(s, d).withColumn("dataset_id", F.expr("CASE WHEN status = 'VERIFIED' THEN dataset_id ELSE 'other-' || dataset_id END")),
        "members": fx.constituents(s, d).withColumn("symbol", F.when(F.col("token").cast("int") % 6 == 0, " ").otherwise(F.col("symbol"))),
        "quarantined": datasets(s, d), "issues": q.validate_raw(sorted_out(s, d)),
        "paper_sessions": fx.promotion_reviews(s, d).select("run_id"), "runs": fx.equity_curve(s, d).select(F.expr("CASE WHEN run_id = 'run-3' THEN 'other' ELSE run_id END").alias("run_id")),
    }


add("q24_integrity_checks", lambda s, d: q.integrity_checks(tables(s, d)),
    f"""SELECT 'ORPHAN_FILLS' AS check_type, count(*) AS issue_count FROM fills WHERE order_id % 50 = 0
    UNION ALL SELECT 'ORPHAN_COST_ROWS', count(*) FROM fills WHERE order_id % 20 = 0
    UNION ALL SELECT 'BROKEN_DATASET_LINEAGE', count(*) FROM bars WHERE {NUM} % 5 = 4
    UNION ALL SELECT 'BLANK_MEMBERS', count(*) FROM constituents WHERE CAST(token AS INT) % 6 = 0
    UNION ALL SELECT 'QUARANTINE_WITHOUT_ISSUES', count(*) FROM ds WHERE {NUM} % 3 = 0
    UNION ALL SELECT 'SESSIONS_WITHOUT_RUNS', count(*) FROM reviews WHERE run_id = 'run-3'""", "check_type", "issue_count", ds=DS)


def gap_reports(s, d):
    gaps = dayed(q.check_missing_days(fx.bars(s, d), sessions(s, d))).groupBy("symbol").agg(F.collect_list("day").alias("gaps"))
    new = gaps.select("symbol", F.to_json(F.struct("gaps")).alias("details"), F.lit(2).alias("checked_at"))
    return new.unionByName(new.select("symbol", F.lit('{"gaps":["1990-01-01"]}').alias("details"), F.lit(1).alias("checked_at")))


add("q25_systemic_gaps", lambda s, d: q.systemic_gaps(gap_reports(s, d), 0.7),
    f"""SELECT day AS gap_date, count(*) AS symbols FROM ({MISSING.format(kind="s.kind <> 'SPECIAL_SESSION' AND")}) GROUP BY 1
    HAVING count(*) >= greatest(2, ceil((SELECT count(DISTINCT symbol) FROM bars) * 0.7::DOUBLE))""", "gap_date", "symbols", bounds=BOUND)
add("q26_resolve_stranded", lambda s, d: q.resolve_stranded(datasets(s, d), fx.raw_bars(s, d).withColumn("dataset_id", F.expr("CASE WHEN substring_index(symbol, '_', -1) % 2 = 0 THEN dataset_id ELSE 'other-' || dataset_id END"))),
    f"""SELECT ds.dataset_id, coalesce(n, 0) AS rows, CASE WHEN n > 0 THEN 'REPLAY' ELSE 'REJECT_EMPTY' END AS action FROM ds
    LEFT JOIN (SELECT dataset_id, count(*) AS n FROM raw_bars WHERE {NUM} % 2 = 0 GROUP BY 1) r USING (dataset_id) WHERE lifecycle_status = 'RAW_RECORDED'""",
    "dataset_id action", "rows", ds=DS)
add("q27_frame_certificate",
    lambda s, d: q.frame_certificate(fx.bars(s, d).withColumn("dataset_id", F.concat(F.lit("ds-"), F.col("symbol"))), ["symbol", "timestamp", "close"]).withColumn("ids", F.array_join("dataset_ids", ",")),
    "SELECT count(*) AS rows, string_agg(DISTINCT 'ds-' || symbol, ',' ORDER BY 'ds-' || symbol) AS ids, 'UNADJUSTED' AS basis FROM bars", "ids basis", "rows")
