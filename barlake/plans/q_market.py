"""Corporate-action, calendar and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import actions as ca
from barlake.operators import calendar as cal
from barlake.operators import universe as u
from barlake.operators.features import panel_exclusions
from barlake.plans import fixtures as fx
from barlake.plans import q_features as qf
from barlake.plans.q_quality import NUM, dayed, minute_bars, sessions, ts
from barlake.plans.q_quality import MINUTES
from barlake.plans.registry import add

W = qf.W


def ba(s, d):
    return fx.bars(s, d), fx.corporate_actions(s, d)


# --- corporate actions -----------------------------------------------------------------------
def terms(s, d):
    """Face-value and bonus terms derived from parts."""
    p = fx.table(s, d, "part")
    kind = F.expr("CASE p_size % 4 WHEN 0 THEN 'bonus' WHEN 1 THEN 'split' WHEN 2 THEN 'consolidation' ELSE 'dividend' END")
    return p.select("p_partkey", kind.alias("action_type"), F.when(F.col("p_size") % 4 == 0, F.col("p_size") - 8).alias("bonus_new_shares"), F.lit(4).alias("bonus_existing_shares"),
                    F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("old_face_value"), F.lit(5).alias("new_face_value"), F.lit(None).cast("double").alias("share_multiplier"))


add("ca01_normalize_actions", lambda s, d: ca.normalize_actions(terms(s, d)),
    """SELECT p_partkey, upper(k) AS action_type, m AS share_multiplier, CASE WHEN m IS NULL THEN 'MISSING_TERMS' WHEN m <= 0 THEN 'NON_POSITIVE_MULTIPLIER' END AS rejected FROM (
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'bonus' WHEN 1 THEN 'split' WHEN 2 THEN 'consolidation' ELSE 'dividend' END AS k,
    CASE p_size % 4 WHEN 0 THEN (4 + p_size - 8) / 4.0 WHEN 3 THEN 1.0 ELSE CASE WHEN p_size % 3 > 0 THEN p_size / 5.0 END END AS m FROM part)""",
    "p_partkey action_type rejected", "share_multiplier")
add("ca02_action_id", lambda s, d: ca.action_id(fx.corporate_actions(s, d).withColumn("source_event_id", F.when(F.col("action_type") == "SPLIT", F.concat(F.lit("E-"), F.col("symbol"))))).withColumn("day", F.date_format("ex_date", "yyyy-MM-dd")),
    """SELECT symbol, strftime(ex_date, '%Y-%m-%d') AS day, 'act_' || substr(sha256(CASE WHEN action_type = 'SPLIT' THEN 'MANUAL:E-' || symbol || ':' || symbol || ':' || strftime(ex_date, '%Y-%m-%d')
    ELSE concat_ws(':', 'MANUAL', symbol, strftime(ex_date, '%Y-%m-%d'), action_type, share_multiplier::VARCHAR, coalesce(dividend_amount, 0.0::DOUBLE)::VARCHAR) END), 1, 16) AS action_id FROM actions""",
    "symbol day action_id")
add("ca03_actions_between", lambda s, d: ca.actions_between(fx.corporate_actions(s, d), None, "1999-01-01", "2000-12-31").withColumn("day", F.date_format("ex_date", "yyyy-MM-dd")),
    "SELECT symbol, strftime(ex_date, '%Y-%m-%d') AS day, action_type FROM actions WHERE ex_date BETWEEN '1999-01-01' AND '2000-12-31'", "symbol day action_type")


def doubled(s, d):
    """Actions with a second same-day share action for some symbols."""
    a = fx.corporate_actions(s, d)
    extra = a.filter("action_type = 'SPLIT' AND substring_index(symbol, '_', -1) % 2 = 0").withColumn("action_type", F.lit("BONUS")).withColumn("share_multiplier", F.lit(1.25))
    return ca.action_id(a.unionByName(extra))


DOUBLED = f"SELECT * FROM actions UNION ALL SELECT symbol, ex_date, 'BONUS', 1.25, dividend_amount FROM actions WHERE action_type = 'SPLIT' AND {NUM} % 2 = 0"
add("ca04_compose_same_day", lambda s, d: ca.compose_same_day(doubled(s, d)).withColumn("day", F.date_format("ex_date", "yyyy-MM-dd")).withColumn("parts", F.size(F.split("action_id", r"\+"))),
    """SELECT symbol, strftime(ex_date, '%Y-%m-%d') AS day, product(share_multiplier) AS share_multiplier, count(*) AS parts,
    CASE WHEN count(DISTINCT action_type) = 1 THEN min(action_type) ELSE 'COMPOSITE' END AS action_type FROM doubled WHERE action_type <> 'DIVIDEND' GROUP BY 1, 2""",
    "symbol day action_type parts", "share_multiplier", doubled=DOUBLED)
SF = "coalesce((SELECT product(share_multiplier) FROM actions a WHERE a.symbol = {0}.symbol AND a.action_type <> 'DIVIDEND' AND a.ex_date > {0}.{1}), 1)"
add("ca05_split_factors", lambda s, d: ca.split_factors(*ba(s, d)), f"SELECT symbol, day, {SF.format('b', 'd')} AS split_factor FROM bars b", "symbol day", "split_factor")
PAID = "SELECT symbol, ex_date, sum(dividend_amount) AS amount FROM actions WHERE action_type = 'DIVIDEND' GROUP BY 1, 2"
TERMS = """SELECT p.*, (SELECT arg_max(close, timestamp) FROM bars b WHERE b.symbol = p.symbol AND b.d < p.ex_date) AS pc FROM {0} p"""
DF = "coalesce((SELECT product(1 - amount / pc) FROM {1} t WHERE t.symbol = {0}.symbol AND t.ex_date > {0}.d AND pc > amount), 1)"
PAIDS = f"SELECT symbol, ex_date, amount / {SF.format('paid', 'ex_date')} AS amount FROM paid"
AV = {"paid": PAID, "paid_split": PAIDS, "terms": TERMS.format("paid"), "terms_split": TERMS.format("paid_split")}
add("ca06_dividend_factors", lambda s, d: ca.dividend_factors(*ba(s, d)), f"SELECT symbol, day, {DF.format('b', 'terms')} AS dividend_factor FROM bars b", "symbol day", "dividend_factor", **AV)
add("ca06_dividend_factors_split", lambda s, d: ca.dividend_factors(*ba(s, d), split_adjusted=True),
    f"SELECT symbol, day, {DF.format('b', 'terms_split')} AS dividend_factor FROM bars b", "symbol day", "dividend_factor", **AV)
FACT = f"SELECT b.*, {SF.format('b', 'd')} AS sf, {DF.format('b', 'terms')} AS df, {DF.format('b', 'terms_split')} AS dfs FROM bars b"
PRICES = "open high low close volume"


def adjusted(name: str, target: str, basis: str, price: str, volume: str) -> None:
    add(name, lambda s, d: ca.adjust_bars(*ba(s, d), target, basis),
        f"SELECT symbol, day, '{target}' AS adjustment, open * {price} AS open, high * {price} AS high, low * {price} AS low, close * {price} AS close, {volume} AS volume FROM fact",
        "symbol day adjustment", PRICES, fact=FACT, **AV)


adjusted("ca07_adjust_split", "SPLIT_ADJUSTED", "UNADJUSTED", "(1 / sf)", "round_even(volume * sf, 0)")
adjusted("ca07_adjust_back", "BACK_ADJUSTED", "UNADJUSTED", "(df / sf)", "round_even(volume * sf, 0)")
adjusted("ca07_adjust_split_to_back", "BACK_ADJUSTED", "SPLIT_ADJUSTED", "dfs", "volume")
TR = f"""SELECT symbol, timestamp, day, CASE WHEN lag(c) {W} > 0 THEN (c + coalesce(amount, 0) - lag(c) {W}) / lag(c) {W} ELSE 0 END AS total_return
 FROM (SELECT f.symbol, f.timestamp, f.day, close / sf AS c, amount FROM fact f LEFT JOIN paid_split p ON p.symbol = f.symbol AND p.ex_date = f.d)"""
add("ca08_total_return", lambda s, d: ca.total_return(*ba(s, d)), "SELECT symbol, day, total_return FROM tr", "symbol day", "total_return", fact=FACT, tr=TR, **AV)
add("ca09_total_return_index", lambda s, d: ca.total_return_index(*ba(s, d)).withColumn("lg", F.log("total_return_index")),
    "SELECT symbol, day, ln(100) + sum(ln(1 + total_return)) OVER (PARTITION BY symbol ORDER BY timestamp) AS lg FROM tr", "symbol day", "lg", fact=FACT, tr=TR, **AV)

LOOSE = ca.BasisPolicy(adjusted_tolerance=0.6, raw_tolerance=0.6, max_missing_sessions=3)
COMP = "SELECT symbol, ex_date, product(share_multiplier) AS m FROM actions WHERE action_type <> 'DIVIDEND' GROUP BY 1, 2 HAVING product(share_multiplier) <> 1"
NB = "SELECT symbol, d, timestamp, open, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM bars"
PRE = "SELECT c.*, (SELECT max(rn) FROM nb WHERE nb.symbol = c.symbol AND nb.d < c.ex_date) AS pre FROM comp c WHERE c.symbol IN (SELECT symbol FROM bars)"
SEEN = """SELECT p.symbol, p.ex_date, p.m, max(CASE WHEN rn = pre THEN close END) AS pc, max(CASE WHEN rn = pre + 1 THEN open END) AS eo, max(CASE WHEN rn = pre THEN d END) AS d0, max(CASE WHEN rn = pre + 1 THEN d END) AS d1,
 quantile_cont(CASE WHEN rn <= pre THEN close * volume END, 0.5) / nullif(quantile_cont(CASE WHEN rn > pre THEN close * volume END, 0.5), 0) AS tr,
 quantile_cont(CASE WHEN rn <= pre THEN volume::DOUBLE END, 0.5) / nullif(quantile_cont(CASE WHEN rn > pre THEN volume::DOUBLE END, 0.5), 0) AS vr
 FROM pre p LEFT JOIN nb ON nb.symbol = p.symbol AND nb.rn BETWEEN pre - 4 AND pre + 5 GROUP BY 1, 2, 3"""
GAPS = """SELECT *, (SELECT count(*) FROM sessions WHERE session_date > d0 AND session_date < d1) AS miss, date_diff('day', d0, d1) AS gapd FROM seen"""
DIST = """SELECT *, pc IS NULL OR eo IS NULL AS absent, CASE WHEN pc IS NOT NULL AND eo IS NOT NULL AND miss <= 3 AND gapd <= 7 THEN pc / eo END AS ratio FROM gaps"""
DET = """SELECT *, abs(ln(m / ratio)) AS lr, abs(ln(ratio)) AS la, CASE WHEN ratio IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(ln(ratio)) <= 0.6 AND abs(ln(m / ratio)) > 0.6 THEN 'SPLIT_ADJUSTED'
 WHEN abs(ln(m / ratio)) <= 0.6 AND abs(ln(ratio)) > 0.6 THEN 'UNADJUSTED' ELSE 'AMBIGUOUS' END AS detection,
 coalesce(CASE WHEN abs(ln(ratio)) <= 0.6 AND abs(ln(m / ratio)) > 0.6 THEN 1 - abs(ln(ratio)) / (abs(ln(ratio)) + abs(ln(m / ratio)))
 WHEN abs(ln(m / ratio)) <= 0.6 AND abs(ln(ratio)) > 0.6 THEN 1 - abs(ln(m / ratio)) / (abs(ln(ratio)) + abs(ln(m / ratio))) WHEN abs(ln(ratio)) <= 0.6 THEN 0.5 ELSE 0 END, 0) AS strength FROM dist"""
CAV = {"comp": COMP, "nb": NB, "pre": PRE, "seen": SEEN, "gaps": GAPS, "dist": DIST, "det": DET}


def found(s, d):
    return ca.detect_basis(*ba(s, d), sessions(s, d), LOOSE)


add("ca10_detect_basis", lambda s, d: found(s, d).withColumn("day", F.date_format("ex_date", "yyyy-MM-dd")).withColumn("evidence", F.array_join("evidence_codes", ",")),
    """SELECT symbol, strftime(ex_date, '%Y-%m-%d') AS day, detection, concat_ws(',', CASE WHEN absent THEN 'SESSION_GAP_EXCEEDED' END, CASE WHEN NOT absent AND abs(ln(m)) <= 1.2 THEN 'POOR_HYPOTHESIS_SEPARATION' END,
    CASE WHEN NOT absent AND ratio IS NULL THEN 'SESSION_GAP_EXCEEDED' END, CASE WHEN ratio IS NOT NULL AND abs(ln(tr)) > 1.2 THEN 'TURNOVER_DISCONTINUITY' END,
    CASE WHEN detection = 'SPLIT_ADJUSTED' THEN 'ADJUSTED_RATIO_MATCH' WHEN detection = 'UNADJUSTED' THEN 'RAW_RATIO_MATCH' WHEN la <= 0.6 THEN 'BOTH_RATIO_MATCH' WHEN ratio IS NOT NULL THEN 'NEITHER_RATIO_MATCH' END) AS evidence,
    ratio AS observed_ratio, lr AS log_distance_raw, CASE WHEN ratio IS NOT NULL THEN tr END AS turnover_ratio, CASE WHEN ratio IS NOT NULL THEN vr END AS volume_ratio, strength AS evidence_strength FROM det""",
    "symbol day detection evidence", "observed_ratio log_distance_raw turnover_ratio volume_ratio evidence_strength", **CAV)


def declared(s, d):
    n = F.substring_index("symbol", "_", -1).cast("int") % 3
    return fx.bars(s, d).select("symbol").distinct().select(
        "symbol", F.concat(F.lit("ds-"), F.col("symbol")).alias("dataset_id"), F.when(n == 0, "UNADJUSTED").when(n == 1, "SPLIT_ADJUSTED").alias("declared"))


INF = f"""SELECT *, CASE WHEN dec IS NULL THEN emp WHEN emp = 'VERIFIED' AND dec = meas THEN 'VERIFIED' WHEN emp = 'VERIFIED' THEN 'CONTRACT_CONFLICT' ELSE 'OVERRIDDEN' END AS validation_status,
 CASE WHEN dec IS NOT NULL AND emp <> 'VERIFIED' THEN dec ELSE meas END AS price_basis FROM (
 SELECT *, CASE WHEN r AND a THEN 'MIXED_BASIS' WHEN m THEN 'AMBIGUOUS' WHEN i THEN 'INSUFFICIENT_EVIDENCE' ELSE 'VERIFIED' END AS emp,
 CASE WHEN r AND a THEN coalesce(dec, 'UNADJUSTED') WHEN a THEN 'SPLIT_ADJUSTED' WHEN r THEN 'UNADJUSTED' ELSE coalesce(dec, 'UNADJUSTED') END AS meas FROM (
 SELECT b.symbol, CASE {NUM.replace('symbol', 'b.symbol')} % 3 WHEN 0 THEN 'UNADJUSTED' WHEN 1 THEN 'SPLIT_ADJUSTED' END AS dec, coalesce(bool_or(detection = 'UNADJUSTED'), false) AS r, coalesce(bool_or(detection = 'SPLIT_ADJUSTED'), false) AS a,
 coalesce(bool_or(detection = 'AMBIGUOUS'), false) AS m, coalesce(bool_or(detection = 'INSUFFICIENT_EVIDENCE'), false) AS i, avg(strength) AS mean_s, min(strength) AS min_s
 FROM (SELECT DISTINCT symbol FROM bars) b LEFT JOIN det ON det.symbol = b.symbol GROUP BY 1, 2))"""
add("ca11_infer_basis", lambda s, d: ca.infer_basis(declared(s, d), found(s, d)),
    """SELECT 'ds-' || symbol AS dataset_id, price_basis, emp AS empirical_status, validation_status, CASE WHEN mean_s IS NULL THEN 1 WHEN emp = 'VERIFIED' AND (r OR a) THEN min_s WHEN emp = 'VERIFIED' THEN 1 ELSE mean_s END AS evidence_strength FROM inf""",
    "dataset_id price_basis empirical_status validation_status", "evidence_strength", inf=INF, **CAV)
add("ca12_basis_summary", lambda s, d: ca.basis_summary(found(s, d)),
    "SELECT symbol, count(*) FILTER (detection = 'UNADJUSTED') AS num_raw, count(*) FILTER (detection = 'SPLIT_ADJUSTED') AS num_adjusted, count(*) FILTER (detection = 'AMBIGUOUS') AS num_ambiguous, count(*) FILTER (detection = 'INSUFFICIENT_EVIDENCE') AS num_insufficient FROM det GROUP BY 1",
    "symbol", "num_raw num_adjusted num_ambiguous num_insufficient", **CAV)


def clean_raw(s, d):
    """Provider rows of the bars; every fifth symbol has one bad row and must be set aside."""
    b = fx.bars(s, d)
    bad = (F.substring_index("symbol", "_", -1) % 5 == 4) & (F.dayofmonth("timestamp") == 11)
    return b.select(F.concat(F.lit("ds-"), F.col("symbol")).alias("dataset_id"), "symbol", F.unix_timestamp("timestamp").alias("source_row_number"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                    *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")], F.when(bad, "-1").otherwise(F.col("volume").cast("string")).alias("volume"))


PROMO = f"""SELECT f.symbol, f.day, price_basis, validation_status, close / CASE WHEN price_basis = 'UNADJUSTED' THEN sf ELSE 1 END AS close,
 round_even(volume * CASE WHEN price_basis = 'UNADJUSTED' THEN sf ELSE 1 END, 0) AS volume FROM fact f JOIN inf ON inf.symbol = f.symbol
 WHERE validation_status IN ('VERIFIED', 'OVERRIDDEN') AND CAST(split_part(f.symbol, '_', 2) AS INT) % 5 <> 4"""
add("ca13_promote_datasets", lambda s, d: ca.promote_datasets(clean_raw(s, d), fx.corporate_actions(s, d), sessions(s, d), declared(s, d), LOOSE), PROMO,
    "symbol day price_basis validation_status", "close volume", fact=FACT, inf=INF, **AV, **CAV)


def with_empty(s, d):
    return declared(s, d).unionByName(fx.table(s, d, "region").select(F.col("r_name").alias("symbol"), F.concat(F.lit("ds-"), F.col("r_name")).alias("dataset_id"), F.lit(None).cast("string").alias("declared")))


add("ca14_revalidate_datasets", lambda s, d: ca.revalidate_datasets(with_empty(s, d), *ba(s, d), sessions(s, d), LOOSE),
    """SELECT 'ds-' || symbol AS dataset_id, validation_status, validation_status IN ('VERIFIED', 'OVERRIDDEN') AS admitted, n AS bar_count FROM inf JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) USING (symbol)
    UNION ALL SELECT 'ds-' || r_name, 'EMPTY', false, 0 FROM region""", "dataset_id validation_status admitted", "bar_count", inf=INF, **CAV)

# --- calendar --------------------------------------------------------------------------------
add("cal1_sessions", lambda s, d: dayed(sessions(s, d)).withColumns({"opens": F.unix_timestamp("open_at"), "closes": F.unix_timestamp("close_at")}),
    "SELECT day, kind, epoch(open_at) AS opens, epoch(close_at) AS closes FROM sessions", "day kind", "opens closes")
ORD = "SELECT o_orderkey, o_orderdate + (o_orderkey % 720) * INTERVAL 1 MINUTE AS t FROM orders"


def clocked(s, d):
    """Orders placed at minutes spread over the day."""
    return fx.table(s, d, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 720).cast("int"))).alias("timestamp"))


LEFTS = "ord LEFT JOIN sessions ON session_date = (t + INTERVAL 330 MINUTE)::DATE"
add("cal2_session_flags", lambda s, d: cal.session_flags(clocked(s, d), sessions(s, d)),
    f"SELECT o_orderkey, open_at IS NOT NULL AS is_trading_day, coalesce(t BETWEEN open_at AND close_at, false) AS is_session_open FROM {LEFTS}", "o_orderkey is_trading_day is_session_open", ord=ORD)
SEG = "CASE o_orderpriority WHEN '1-URGENT' THEN 'MCX' WHEN '2-HIGH' THEN 'CDS' WHEN '3-MEDIUM' THEN 'NSE' WHEN '5-LOW' THEN 'NCDEX' ELSE 'ELSEWHERE' END"
add("cal3_segment_hours", lambda s, d: cal.segment_hours(fx.table(s, d, "orders").withColumn("exchange", F.expr(SEG))).groupBy("exchange", "segment_open", "segment_close").agg(F.count(F.lit(1)).alias("n")),
    f"""SELECT {SEG} AS exchange, CASE {SEG} WHEN 'MCX' THEN '09:00' WHEN 'CDS' THEN '09:00' WHEN 'NCDEX' THEN '09:00' ELSE '09:15' END AS segment_open,
    CASE {SEG} WHEN 'MCX' THEN '23:30' WHEN 'CDS' THEN '17:00' WHEN 'NCDEX' THEN '17:00' ELSE '15:30' END AS segment_close, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
    "exchange segment_open segment_close", "n")
add("cal4_session_bar_index", lambda s, d: cal.session_bar_index(minute_bars(s, d)).withColumn("minute", F.date_format("timestamp", "yyyy-MM-dd HH:mm")),
    "SELECT symbol, strftime(timestamp, '%Y-%m-%d %H:%M') AS minute, row_number() OVER (PARTITION BY symbol, (timestamp + INTERVAL 330 MINUTE)::DATE ORDER BY timestamp) - 1 AS session_bar_index FROM minutes",
    "symbol minute", "session_bar_index", minutes=MINUTES)
add("cal5_session_progress", lambda s, d: cal.session_progress(clocked(s, d), sessions(s, d)),
    f"SELECT o_orderkey, CASE WHEN open_at IS NOT NULL THEN greatest(0, least(1, (epoch(t) - epoch(open_at)) / (epoch(close_at) - epoch(open_at)))) END AS session_progress FROM {LEFTS}", "o_orderkey", "session_progress", ord=ORD)
add("cal6_drop_out_of_session", lambda s, d: cal.drop_out_of_session(fx.bars(s, d), sessions(s, d)), "SELECT symbol, day FROM bars WHERE d IN (SELECT session_date FROM sessions)", "symbol day")
TF = "CASE o_orderkey % 7 WHEN 0 THEN '1m' WHEN 1 THEN '5m' WHEN 2 THEN '15m' WHEN 3 THEN '1h' WHEN 4 THEN '2h' WHEN 5 THEN '1d' ELSE 'm' END"
add("cal7_annualization", lambda s, d: fx.table(s, d, "orders").select(F.expr(TF).alias("timeframe")).distinct().withColumn("factor", cal.annualization(F.col("timeframe"))),
    f"SELECT DISTINCT {TF} AS timeframe, 252.0 * CASE o_orderkey % 7 WHEN 0 THEN 375 WHEN 1 THEN 75 WHEN 2 THEN 25 WHEN 3 THEN 6 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 375 END AS factor FROM orders", "timeframe", "factor")
add("cal8_completed_only", lambda s, d: cal.completed_only(fx.bars(s, d), sessions(s, d), ts("1999-06-30 08:00:00")),
    "SELECT symbol, b.day FROM bars b JOIN sessions ON d = session_date WHERE close_at <= '1999-06-30 08:00:00'", "symbol day")
add("cal9_latest_completed_session", lambda s, d: dayed(cal.latest_completed_session(sessions(s, d), ts("1999-06-30 08:00:00"))),
    "SELECT max(day) AS day FROM sessions WHERE close_at <= '1999-06-30 08:00:00'", "day")
add("cal10_backfill_plan",
    lambda s, d: cal.backfill_plan(fx.bars(s, d).withColumn("symbol", F.expr("CASE WHEN substring_index(symbol, '_', -1) % 4 = 1 THEN 'unknown-' || symbol ELSE symbol END")), fx.bars(s, d).select("symbol").distinct(), "1994-01-01", "2003-12-31", 200).select(
        "symbol", F.date_format("window_start", "yyyy-MM-dd").alias("a"), F.date_format("window_end", "yyyy-MM-dd").alias("b")),
    f"""SELECT symbol, strftime(w, '%Y-%m-%d') AS a, strftime(least((w + INTERVAL 199 DAY)::DATE, e), '%Y-%m-%d') AS b FROM (SELECT symbol, e, unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 200 DAY))::DATE AS w FROM (
    SELECT symbol, DATE '1994-01-01' AS s, coalesce(f - 1, DATE '2003-12-31') AS e FROM have UNION ALL SELECT symbol, l + 1, DATE '2003-12-31' FROM have WHERE l IS NOT NULL) WHERE s <= e)""", "symbol a b",
    have=f"SELECT symbol, min(d) FILTER ({NUM} % 4 <> 1) AS f, max(d) FILTER ({NUM} % 4 <> 1) AS l FROM bars GROUP BY 1")

# --- universe --------------------------------------------------------------------------------
MEM = f"""SELECT n_name AS symbol, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '-EQ' ELSE n_name END AS provider_symbol, CASE WHEN n_nationkey % 11 <> 10 THEN n_nationkey::VARCHAR END AS provider_token,
 CASE WHEN n_nationkey % 9 = 8 THEN DATE '2000-01-01' END AS active_to, n_nationkey % 7 <> 6 AS data_eligible, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey"""


def members(s, d):
    n, r = fx.table(s, d, "nation"), fx.table(s, d, "region")
    k = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("symbol"), F.when(k % 3 == 0, F.concat("n_name", F.lit("-EQ"))).otherwise(F.col("n_name")).alias("provider_symbol"),
        F.when(k % 11 != 10, k.cast("string")).alias("provider_token"), F.when(k % 9 == 8, F.lit("2000-01-01").cast("date")).alias("active_to"), (k % 7 != 6).alias("data_eligible"), F.col("r_name").alias("sector"))


def instruments(s, d):
    """Listed instruments: nations as names, some with the -EQ suffix, some under a name that no member has."""
    n = fx.table(s, d, "nation")
    k = F.col("n_nationkey")
    return n.select(F.when(k % 8 == 7, F.concat(F.lit("OTHER_"), "n_name")).when(k % 3 == 0, F.concat("n_name", F.lit("-EQ"))).otherwise(F.col("n_name")).alias("symbol"), (k + 1000).cast("string").alias("token"),
                                       F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'NSE' WHEN 1 THEN 'NSE_CM' ELSE 'MCX' END").alias("exchange"), F.concat(F.lit("Index - "), F.col("n_name")).alias("name"),
                                       F.expr("CASE WHEN n_nationkey % 5 = 0 THEN 'AMXIDX' ELSE '' END").alias("instrument_type"))


INS = """SELECT CASE WHEN n_nationkey % 8 = 7 THEN 'OTHER_' || n_name WHEN n_nationkey % 3 = 0 THEN n_name || '-EQ' ELSE n_name END AS symbol, (n_nationkey + 1000)::VARCHAR AS token, CASE n_nationkey % 3 WHEN 0 THEN 'NSE' WHEN 1 THEN 'NSE_CM' ELSE 'MCX' END AS exchange,
 'Index - ' || n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'AMXIDX' ELSE '' END AS instrument_type FROM nation"""
add("u01_import_members", lambda s, d: u.import_members(fx.table(s, d, "nation").select(F.col("n_name").alias("symbol")), instruments(s, d)),
    "SELECT n_name AS symbol, coalesce(a.symbol, b.symbol) AS provider_symbol, coalesce(a.token, b.token) AS provider_token FROM nation LEFT JOIN ins a ON a.symbol = n_name LEFT JOIN ins b ON b.symbol = n_name || '-EQ'",
    "symbol provider_symbol provider_token", ins=INS)
add("u02_eligible_members", lambda s, d: u.eligible_members(members(s, d)), "SELECT symbol FROM mem WHERE active_to IS NULL AND data_eligible AND provider_token IS NOT NULL", "symbol", mem=MEM)
add("u03_universe_as_of", lambda s, d: u.universe_as_of(fx.constituents(s, d), "1996-06-01", "1996-06-01", "all"),
    "SELECT symbol, instrument_id FROM constituents WHERE effective_from <= '1996-06-01' AND (effective_until IS NULL OR effective_until > '1996-06-01') AND (known_from IS NULL OR known_from <= '1996-06-01')", "symbol instrument_id")
add("u04_mark_pit", lambda s, d: u.mark_pit(fx.bars(s, d), fx.constituents(s, d)), f"SELECT symbol, day, {qf.PIT} AS pit_eligible FROM bars b", "symbol day pit_eligible")


def short_evidence(s, d):
    """All membership intervals, none known to last beyond the middle of 1996."""
    end = F.lit("1996-06-01").cast("date")
    return fx.constituents(s, d).withColumn("effective_until", F.least(F.coalesce("effective_until", end), end))


add("u05_pit_coverage", lambda s, d: u.pit_coverage(fx.bars(s, d), short_evidence(s, d)),
    """SELECT reason FROM (SELECT 'EVIDENCE_STARTS_AFTER_PANEL' AS reason, (SELECT min(effective_from) FROM short) > (SELECT min(d) FROM bars) AS hit
    UNION ALL SELECT 'EVIDENCE_ENDS_BEFORE_PANEL', (SELECT max(effective_until) FROM short) <= (SELECT max(d) FROM bars)
    UNION ALL SELECT 'INVALID_INTERVAL', (SELECT count(*) FROM short WHERE effective_until <= effective_from) > 0) WHERE hit""", "reason",
    short="SELECT * REPLACE (coalesce(least(effective_until, DATE '1996-06-01'), DATE '1996-06-01') AS effective_until) FROM constituents")


def crossing(s, d):
    c = fx.constituents(s, d)
    return c.withColumn("effective_from", F.when((F.col("effective_from") == "2000-01-01") & (F.col("token").cast("int") % 20 == 0), F.lit("1998-06-01").cast("date")).otherwise(F.col("effective_from")))


CROSS = "SELECT * REPLACE (CASE WHEN effective_from = '2000-01-01' AND CAST(token AS INT) % 20 = 0 THEN DATE '1998-06-01' ELSE effective_from END AS effective_from) FROM constituents"
add("u06_interval_overlaps", lambda s, d: u.interval_overlaps(crossing(s, d)).select("symbol", F.date_format("effective_from", "yyyy-MM-dd").alias("day")),
    """SELECT a.symbol, strftime(a.effective_from, '%Y-%m-%d') AS day FROM crossed a WHERE EXISTS (SELECT 1 FROM crossed b WHERE b.instrument_id = a.instrument_id AND b.effective_from < a.effective_from
    AND coalesce(b.effective_until, DATE '9999-12-31') > a.effective_from)""", "symbol day", crossed=CROSS)
add("u07_universe_history", lambda s, d: u.universe_history(fx.constituents(s, d), "all").withColumn("day", F.date_format("event_date", "yyyy-MM-dd")),
    "SELECT symbol, strftime(effective_from, '%Y-%m-%d') AS day, 'ADD' AS event FROM constituents UNION ALL SELECT symbol, strftime(effective_until, '%Y-%m-%d'), 'REMOVE' FROM constituents WHERE effective_until IS NOT NULL", "symbol day event")


def quality_log(s, d):
    o = fx.table(s, d, "orders")
    return o.select(F.concat(F.lit("NATION_"), F.col("o_custkey") % 30).alias("symbol"), F.lit("1d").alias("timeframe"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'session_alignment' ELSE 'schema' END").alias("check_type"),
                    (F.col("o_orderkey") % 5).alias("issue_count"), F.col("o_orderkey").alias("checked_at"))


# Fixture keys of orders are unique, so the newest report of a symbol is the one with the highest key.
READY = f"""SELECT (SELECT count(*) FROM act) AS member_count, (SELECT count(provider_token) FROM act) AS token_count, (SELECT count(*) FILTER (n > 0) FROM per) AS symbols_with_data, (SELECT count(*) FILTER (n >= 253) FROM per) AS symbols_with_lookback,
 (SELECT count(*) FROM bars WHERE symbol = 'NATION_1') AS benchmark_rows, (SELECT coalesce(sum(i), 0) FROM (SELECT arg_max(o_orderkey % 5, o_orderkey) AS i FROM orders WHERE o_orderkey % 2 = 0
 AND 'NATION_' || (o_custkey % 30) IN (SELECT symbol FROM mem UNION SELECT provider_symbol FROM mem UNION SELECT 'NATION_1') GROUP BY o_custkey % 30)) AS calendar_exceptions"""
add("u08_readiness",
    lambda s, d: u.readiness(members(s, d), fx.bars(s, d), quality_log(s, d), fx.table(s, d, "nation").filter("n_nationkey = 1").select(F.col("n_name").alias("provider_symbol"), F.lit("EXACT").alias("relationship"))).withColumns(
        {"blockers": F.array_join("blockers", ","), "warnings": F.array_join("warnings", ",")}),
    """SELECT *, blockers = '' AS ready FROM (SELECT *, concat_ws(',', CASE WHEN member_count <> 200 THEN 'SNAPSHOT_MEMBER_COUNT:' || member_count END, CASE WHEN token_count < member_count THEN 'MISSING_PROVIDER_TOKENS:' || (member_count - token_count) END,
    CASE WHEN symbols_with_data < member_count THEN 'MISSING_MEMBER_DATA:' || (member_count - symbols_with_data) END,
    CASE WHEN symbols_with_lookback < ceil(member_count * 0.8::DOUBLE) THEN 'INSUFFICIENT_ELIGIBLE_UNIVERSE:' || symbols_with_lookback || '/' || CAST(ceil(member_count * 0.8::DOUBLE) AS BIGINT) END,
    CASE WHEN benchmark_rows < 253 THEN 'BENCHMARK_LOOKBACK:' || benchmark_rows END, CASE WHEN calendar_exceptions > 0 THEN 'UNRESOLVED_CALENDAR_EXCEPTIONS:' || calendar_exceptions::BIGINT END) AS blockers,
    CASE WHEN symbols_with_lookback >= ceil(member_count * 0.8::DOUBLE) AND symbols_with_lookback < member_count THEN 'SHORT_LISTING_HISTORY:' || (member_count - symbols_with_lookback) ELSE '' END AS warnings FROM ready)""",
    "blockers warnings ready", "member_count token_count symbols_with_data symbols_with_lookback benchmark_rows calendar_exceptions", mem=MEM,
    act="SELECT * FROM mem WHERE active_to IS NULL AND data_eligible", per="SELECT act.symbol, count(b.timestamp) AS n FROM act LEFT JOIN bars b ON b.symbol = act.provider_symbol GROUP BY 1", ready=READY)


def aliases(s, d):
    k = F.col("n_nationkey")
    n = fx.table(s, d, "nation")
    both = F.array(F.struct(F.lit("PROXY").alias("relationship"), F.concat(F.lit("P-"), "n_name").alias("provider_symbol"), F.lit(True).alias("approved_for_research")),
                   F.struct(F.lit("EXACT").alias("relationship"), F.concat(F.lit("E-"), "n_name").alias("provider_symbol"), (k % 2 == 0).alias("approved_for_research")))
    return n.select(F.concat("n_name", F.lit("X")).alias("canonical_symbol"), F.inline(both))


add("u09_resolve_benchmark",
    lambda s, d: u.resolve_benchmark(fx.table(s, d, "nation").select(F.explode(F.array("n_name", F.concat("n_name", F.lit("X")))).alias("symbol")), aliases(s, d), fx.bars(s, d)),
    """SELECT DISTINCT symbol, symbol AS provider_symbol, 'EXACT' AS relationship FROM bars UNION ALL SELECT n_name || 'X', CASE WHEN n_nationkey % 2 = 0 THEN 'E-' ELSE 'P-' END || n_name,
    CASE WHEN n_nationkey % 2 = 0 THEN 'EXACT' ELSE 'PROXY' END FROM nation""", "symbol provider_symbol relationship")
add("u10_find_index", lambda s, d: u.find_index(instruments(s, d), "index nation 1 2"), "SELECT symbol, token FROM ins WHERE regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') = 'INDEXNATION12'", "symbol token", ins=INS)
REQ = "SELECT n_name AS rs, CASE n_nationkey % 2 WHEN 0 THEN 'NSE' ELSE 'NSE_CM' END AS re FROM nation"
add("u11_resolve_token",
    lambda s, d: u.resolve_token(fx.table(s, d, "nation").select(F.col("n_name").alias("symbol"), F.expr("CASE n_nationkey % 2 WHEN 0 THEN 'NSE' ELSE 'NSE_CM' END").alias("exchange")), instruments(s, d)),
    "SELECT rs AS symbol, re AS exchange, coalesce(a.token, b.token) AS token FROM req LEFT JOIN ins a ON a.symbol = rs AND a.exchange = re LEFT JOIN ins b ON b.symbol = rs AND b.exchange = CASE re WHEN 'NSE' THEN 'NSE_CM' ELSE 'NSE' END",
    "symbol exchange token", ins=INS, req=REQ)
add("u12_search_symbol", lambda s, d: u.search_symbol(instruments(s, d), "tion_1"), "SELECT symbol FROM ins WHERE upper(symbol) LIKE '%TION\\_1%' ESCAPE '\\'", "symbol", ins=INS)
add("u13_sector_map",
    lambda s, d: u.sector_map(fx.bars(s, d), members(s, d).withColumn("sector", F.nullif("sector", F.lit("ASIA")))).groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n")),
    "SELECT symbol, CASE WHEN sector = 'ASIA' THEN 'UNKNOWN' ELSE sector END AS sector, count(*) AS n FROM bars GROUP BY 1, 2", "symbol sector", "n")
add("u13_missing_sectors", lambda s, d: u.missing_sectors(fx.bars(s, d), members(s, d).withColumn("sector", F.nullif("sector", F.lit("ASIA")))), "SELECT DISTINCT symbol FROM bars WHERE sector = 'ASIA'", "symbol")
add("u14_infer_market", lambda s, d: u.infer_market(instruments(s, d)),
    """SELECT symbol, CASE WHEN exchange = 'MCX' THEN 'COMMODITY' WHEN instrument_type LIKE '%IDX%' THEN 'INDEX' ELSE 'INDIA_EQUITY' END AS asset_class, 'INR' AS currency,
    CASE WHEN exchange = 'MCX' THEN '23:30' ELSE '15:30' END AS session_close, CASE WHEN exchange = 'MCX' THEN '09:00' ELSE '09:15' END AS session_open, 0.05 AS tick_size FROM ins""",
    "symbol asset_class currency session_open session_close", "tick_size", ins=INS)
add("u15_coverage", lambda s, d: u.coverage(fx.bars(s, d)).select("symbol", F.date_format("first_ts", "yyyy-MM-dd").alias("a"), F.date_format("last_ts", "yyyy-MM-dd").alias("b"), "bars"),
    "SELECT symbol, min(day) AS a, max(day) AS b, count(*) AS bars FROM bars GROUP BY 1", "symbol a b", "bars")
add("u15_latest_bar", lambda s, d: u.latest_bar(fx.bars(s, d)), "SELECT symbol, max(day) AS day, arg_max(close, timestamp) AS close, arg_max(volume, timestamp) AS volume FROM bars GROUP BY 1", "symbol day", "close volume")
add("u15_distinct_symbols", lambda s, d: u.distinct_symbols(fx.bars(s, d)), "SELECT DISTINCT symbol FROM bars", "symbol")
add("q07_normalize_symbol", lambda s, d: fx.table(s, d, "part").select("p_partkey", u.normalize_symbol(F.when(F.col("p_size") > 5, F.concat(F.lit("  "), F.col("p_name"))).otherwise(F.lit(" "))).alias("symbol")),
    "SELECT p_partkey, nullif(upper(trim(CASE WHEN p_size > 5 THEN p_name ELSE ' ' END)), '') AS symbol FROM part", "p_partkey symbol")
add("q08_build_instrument_id", lambda s, d: fx.table(s, d, "part").select("p_partkey", u.build_instrument_id(F.lit(" x "), F.col("p_brand")).alias("instrument_id")),
    "SELECT p_partkey, 'X:' || upper(p_brand) || ':EQ' AS instrument_id FROM part", "p_partkey instrument_id")
EXC = """SELECT n_name AS symbol, 'MISSING_DATA' AS reason, '' AS detail FROM nation WHERE n_name NOT IN (SELECT symbol FROM bars)
 UNION ALL SELECT symbol, 'STALE_PRICE', max(day) FROM vb GROUP BY 1 HAVING date_diff('day', max(d), DATE '2001-12-31') > 7
 UNION ALL SELECT e.symbol, 'MISSING_SESSION', s.day FROM (SELECT symbol, min(d) AS a, max(d) AS b FROM vb GROUP BY 1) e JOIN sessions s ON s.session_date BETWEEN e.a AND e.b
 WHERE NOT EXISTS (SELECT 1 FROM vb WHERE vb.symbol = e.symbol AND vb.d = s.session_date)"""
add("f25_panel_exclusions", lambda s, d: panel_exclusions(fx.bars(s, d), fx.table(s, d, "nation").select(F.col("n_name").alias("symbol")), sessions(s, d), F.lit("2001-12-31").cast("date")),
    EXC, "symbol reason detail", vb="SELECT * FROM bars WHERE d IN (SELECT session_date FROM sessions)")
