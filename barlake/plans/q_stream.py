"""Tick queries: batch twins of the streaming operators, and streams over the event files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlake.plans import fixtures as fx
from barlake.plans.q_quality import event_sessions
from barlake.plans.registry import add
from barlake.session import ensure_checkpoint_dir
from barlake.streaming import admission as a
from barlake.streaming import bars as b
from barlake.streaming import packets as pk
from barlake.streaming import sinks

POLICY = a.AdmissionPolicy(allowed_exchanges=("X",))


def good(s, d):
    """All ticks; the few without a positive price get a cent, so that bars and states see every row."""
    return fx.ticks(s, d).withColumn("ltp", F.greatest("ltp", F.lit(0.01)))


GOOD = "SELECT * REPLACE (greatest(ltp, 0.01::DOUBLE) AS ltp) FROM ticks"
US = "epoch_us(exchange_timestamp)"


# --- packets -----------------------------------------------------------------------------------
def packed(s, d):
    """Ticks as binary packets of all four modes; every 50th is cut short."""
    t = fx.ticks(s, d).select("event_id", "token", "sequence_number", F.unix_millis("exchange_timestamp").alias("ms"), F.round(F.col("ltp") * 100).cast("long").alias("raw"), "last_traded_qty", "cumulative_volume")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mode = int(r.event_id % 4) + 1
                rec = np.zeros((), dtype=pk.LAYOUTS[mode])
                rec["mode"], rec["exchange_type"], rec["token"], rec["exchange_ms"] = mode, 13 if r.event_id % 5 == 0 else 1, str(r.token).encode(), r.ms
                if mode < 4:
                    rec["sequence"], rec["ltp"] = r.sequence_number, r.raw
                if mode in (2, 3):
                    rec["ltq"], rec["volume"], rec["high"], rec["buy_qty"] = r.last_traded_qty, r.cumulative_volume, r.raw + 7, r.last_traded_qty * 2
                if mode == 3:
                    for i in range(10):
                        rec["levels"][i] = (1 if i % 2 else 0, r.last_traded_qty + i, r.raw - i if i % 2 else r.raw + i + 1, i)
                if mode == 4:
                    for i in range(20):
                        rec["bids"][i], rec["asks"][i] = (i, r.raw - i, 1), (i, r.raw + i + 1, 1)
                blob = rec.tobytes()
                out.append(blob[:-1] if r.event_id % 50 == 49 else blob)
            yield pd.DataFrame({"packet_id": pdf["event_id"], "payload": out})

    return t.mapInPandas(encode, "packet_id bigint, payload binary")


SC = "CASE WHEN event_id % 5 = 0 THEN 10000000.0 ELSE 100.0 END"
add("s01_decode_packets",
    lambda s, d: pk.decode_packets(packed(s, d)).withColumns({"best_bid": F.get("bids", F.lit(0))["price"], "best_ask": F.get("asks", F.lit(0))["price"], "depth": F.coalesce(F.size("bids"), F.lit(-1)), "ms": F.col("exchange_ms").cast("string")}).na.fill({"depth": -1}),
    f"""SELECT event_id AS packet_id, CASE WHEN bad THEN 'INVALID_PACKET_SIZE' END AS error, CASE WHEN NOT bad THEN CASE md WHEN 1 THEN 'LTP' WHEN 2 THEN 'QUOTE' WHEN 3 THEN 'SNAP_QUOTE' ELSE 'DEPTH20' END END AS mode,
    CASE WHEN NOT bad THEN CASE WHEN event_id % 5 = 0 THEN 'CDE_FO' ELSE 'NSE_CM' END END AS exchange, CASE WHEN NOT bad THEN token END AS token, CASE WHEN NOT bad THEN (epoch_us(exchange_timestamp) // 1000)::VARCHAR END AS ms, CASE WHEN NOT bad AND md < 4 THEN sequence_number END AS sequence_number,
    CASE WHEN NOT bad AND md < 4 THEN raw / {SC} END AS ltp, CASE WHEN NOT bad AND md IN (2, 3) THEN cumulative_volume END AS cumulative_volume, CASE WHEN NOT bad AND md IN (2, 3) THEN (raw + 7) / {SC} END AS day_high,
    CASE WHEN NOT bad AND md = 3 THEN (raw - 1) / {SC} WHEN NOT bad AND md = 4 THEN raw / {SC} END AS best_bid, CASE WHEN NOT bad AND md >= 3 THEN (raw + 1) / {SC} END AS best_ask, CASE WHEN bad OR md < 3 THEN -1 WHEN md = 3 THEN 5 ELSE 20 END AS depth
    FROM (SELECT *, event_id % 4 + 1 AS md, event_id % 50 = 49 AS bad, round(ltp * 100) AS raw FROM ticks)""", "packet_id error mode exchange token ms", "sequence_number ltp cumulative_volume day_high best_bid best_ask depth")


# --- admission -----------------------------------------------------------------------------------
def dirty(s, d):
    """Ticks with missing fields, clock skew and bad volumes by event number."""
    e = F.col("event_id")
    t = fx.ticks(s, d)
    return t.withColumns({
        "token": F.when(e % 41 == 0, " ").otherwise(F.col("token")), "exchange": F.when(e % 43 == 0, F.lit(None)).when(e % 47 == 0, "Z").otherwise(F.col("exchange")),
        "exchange_timestamp": F.when(e % 53 != 0, F.col("exchange_timestamp")), "received_at": F.when(e % 59 == 0, F.col("received_at") - F.expr("INTERVAL '30' SECOND")).otherwise(F.col("received_at")),
        "ltp": F.when(e % 61 == 0, float("nan")).when(e % 67 == 0, -1.0).otherwise(F.col("ltp")), "cumulative_volume": F.when(e % 71 == 0, -5).otherwise(F.col("cumulative_volume"))})


ADM = """SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'MISSING_TOKEN' WHEN event_id % 43 = 0 THEN 'MISSING_EXCHANGE' WHEN event_id % 53 = 0 THEN 'MISSING_EXCHANGE_TIMESTAMP' WHEN event_id % 47 = 0 THEN 'INVALID_EXCHANGE'
 WHEN skew < -1 THEN 'FUTURE_TIMESTAMP_EXCEEDED' WHEN skew > 5 THEN 'STALE_TICK_LATENCY' WHEN isodow(ld) > 5 THEN 'WEEKEND_SESSION_REJECTED' WHEN NOT (epoch_us(ist) BETWEEN epoch_us(ld + INTERVAL 555 MINUTE) AND epoch_us(ld + INTERVAL 930 MINUTE)) THEN 'OUT_OF_SESSION_HOURS'
 WHEN event_id % 61 = 0 THEN 'PRICE_NON_FINITE' WHEN event_id % 67 = 0 OR ltp <= 0 THEN 'PRICE_NON_POSITIVE' WHEN event_id % 71 = 0 THEN 'VOLUME_NEGATIVE' ELSE 'VALID_TICK' END AS reason, skew * 1000 AS latency_ms
 FROM (SELECT *, exchange_timestamp + INTERVAL 330 MINUTE AS ist, CAST(exchange_timestamp + INTERVAL 330 MINUTE AS DATE) AS ld, event_id % 7 - CASE WHEN event_id % 59 = 0 THEN 30 ELSE 0 END AS skew FROM ticks)"""
ACT = "CASE WHEN reason = 'VALID_TICK' THEN 'ACCEPT' WHEN reason = 'STALE_TICK_LATENCY' THEN 'DROP_STALE' WHEN reason LIKE '%SESSION%' THEN 'DROP_OUT_OF_SESSION' ELSE 'REJECT_MALFORMED' END"


def admitted(s, d):
    return a.admit(dirty(s, d), event_sessions(s, d), POLICY)


add("s02_admit", admitted, f"SELECT event_id, reason, {ACT} AS action FROM adm", "event_id reason action", adm=ADM)


def books(s, d):
    """Three-level books around each price; faults by event number."""
    e, p, q = F.col("event_id"), F.greatest("ltp", F.lit(2.0)), F.col("last_traded_qty")
    level = lambda price, qty: F.struct(price.alias("price"), qty.cast("long").alias("quantity"))
    bids = F.array(level(p + F.when(e % 11 == 0, 2.0).otherwise(0.0), q), level(p - 0.5 + F.when(e % 13 == 0, 5.0).otherwise(0.0), q - F.when(e % 17 == 0, 200).otherwise(0)), level(F.when(e % 19 == 0, 0.0).otherwise(p - 0.8), q))
    asks = F.array(level(p + 1, q), level(p + 2 - F.when(e % 23 == 0, 1.5).otherwise(0.0), q), level(p + 3, q))
    return good(s, d).withColumns({"bids": bids, "asks": F.when(e % 29 != 0, asks)})


FAULT = """CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'INVALID_DEPTH_QUANTITY' WHEN event_id % 13 = 0 AND ltp + 4.5 > ltp + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END THEN 'INVALID_DEPTH_ORDERING'
 WHEN event_id % 19 = 0 THEN 'INVALID_DEPTH_PRICE' WHEN event_id % 23 = 0 THEN 'INVALID_DEPTH_ORDERING' WHEN event_id % 11 = 0 THEN 'CROSSED_BOOK_BID_GE_ASK' END"""
add("s03_check_book", lambda s, d: a.check_book(books(s, d)),
    f"SELECT event_id, book_fault, CASE WHEN book_fault IS NULL THEN 'ACCEPT' WHEN book_fault IN ('INVALID_DEPTH_PRICE', 'INVALID_DEPTH_QUANTITY') THEN 'REJECT_MALFORMED' ELSE 'QUARANTINE' END AS book_action FROM (SELECT event_id, {FAULT} AS book_fault FROM ticks)",
    "event_id book_fault book_action")
def depth_ticks(s, d):
    """Every third tick is a depth snapshot without price and volume; the others carry price and books."""
    snapshot = F.col("event_id") % 3 == 0
    return books(s, d).withColumns({"ltp": F.when(~snapshot, F.col("ltp")), "cumulative_volume": F.when(~snapshot, F.col("cumulative_volume")).otherwise(-1)})


add("s02_depth", lambda s, d: a.admit(depth_ticks(s, d), None, POLICY),
    f"""SELECT event_id, reason, CASE WHEN reason = 'VALID_TICK' THEN 'ACCEPT' WHEN reason = 'STALE_TICK_LATENCY' THEN 'DROP_STALE' WHEN reason IN ('INVALID_DEPTH_ORDERING', 'CROSSED_BOOK_BID_GE_ASK') THEN 'QUARANTINE' ELSE 'REJECT_MALFORMED' END AS action
    FROM (SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'STALE_TICK_LATENCY' WHEN event_id % 3 = 0 AND event_id % 29 = 0 THEN 'PRICE_NON_FINITE' ELSE coalesce({FAULT}, 'VALID_TICK') END AS reason FROM (SELECT * REPLACE (greatest(ltp, 2.0::DOUBLE) AS ltp) FROM ticks))""",
    "event_id reason action")
add("s04_dedup", lambda s, d: a.dedup(good(s, d).unionByName(good(s, d).filter("event_id % 3 = 0"))).groupBy("token").agg(F.count(F.lit(1)).alias("ticks")), f"SELECT token, count(*) AS ticks FROM ({GOOD}) GROUP BY 1", "token", "ticks")
STATE_ROWS = "SELECT *, row_number() OVER (PARTITION BY token ORDER BY received_at, event_id) AS srn, CAST(exchange_timestamp + INTERVAL 330 MINUTE AS DATE) AS ld FROM (SELECT * REPLACE (greatest(ltp, 0.01::DOUBLE) AS ltp) FROM ticks)"
LATE = "r.ld = t.ld AND r.us - epoch_us(t.exchange_timestamp) > 500000"
LESS = "r.ld = t.ld AND t.cumulative_volume > 0 AND t.cumulative_volume < r.vol"
JUMP = "r.ld = t.ld AND abs(t.ltp - r.px) / r.px > 0.5::DOUBLE"
SAME = "r.ld = t.ld AND r.sq > 0 AND t.sequence_number > 0 AND t.sequence_number = r.sq"
GAP = "r.ld = t.ld AND r.sq > 0 AND t.sequence_number > 0 AND t.sequence_number <> r.sq + 1"
TAKE = f"NOT ({SAME}) AND NOT ({LATE}) AND NOT ({LESS}) AND NOT ({JUMP})"
STATE_REC = f"""/*RECURSIVE_MARK*/SELECT token, DATE '1900-01-01' AS ld, 0::BIGINT AS srn, 0::BIGINT AS sq, 0::BIGINT AS us, 0.0::DOUBLE AS px, 0::BIGINT AS vol, '' AS action, '' AS gap FROM (SELECT DISTINCT token FROM state_rows)
 UNION ALL SELECT t.token, CASE WHEN {TAKE} THEN t.ld ELSE r.ld END, t.srn, CASE WHEN {TAKE} THEN greatest(r.sq, t.sequence_number) ELSE r.sq END, CASE WHEN {TAKE} THEN epoch_us(t.exchange_timestamp) ELSE r.us END, CASE WHEN {TAKE} THEN t.ltp ELSE r.px END,
 CASE WHEN {TAKE} THEN t.cumulative_volume ELSE r.vol END, CASE WHEN {SAME} THEN 'DROP_DUPLICATE' WHEN {LATE} THEN 'DROP_STALE' WHEN {LESS} THEN 'QUARANTINE' WHEN {JUMP} THEN 'QUARANTINE' ELSE 'ACCEPT' END,
 CASE WHEN {GAP} AND NOT ({SAME}) THEN 'SEQUENCE_GAP_DETECTED,' ELSE '' END || CASE WHEN {SAME} THEN 'DUPLICATE_SEQUENCE_NUMBER' WHEN {LATE} THEN 'OUT_OF_ORDER_TIMESTAMP' WHEN {LESS} THEN 'CUMULATIVE_VOLUME_DECREASE' WHEN {JUMP} THEN 'EXTREME_PRICE_VELOCITY' ELSE 'VALID_TICK' END
 FROM state_rec r JOIN state_rows t ON t.token = r.token AND t.srn = r.srn + 1"""
add("s05_admit_stateful_batch", lambda s, d: a.admit_batch(good(s, d), a.AdmissionPolicy(max_price_velocity=0.5)),
    "SELECT t.token, event_id, action, gap AS reasons FROM state_rec r JOIN state_rows t ON t.token = r.token AND t.srn = r.srn", "token event_id action reasons", state_rows=STATE_ROWS, state_rec=STATE_REC)
add("s06_quarantined", lambda s, d: a.quarantined(admitted(s, d)).withColumn("held_id", F.get_json_object("raw_payload_json", "$.event_id").cast("long")), f"SELECT event_id AS held_id, reason, {ACT} AS action FROM adm WHERE reason <> 'VALID_TICK'", "held_id reason action", adm=ADM)
add("s07_admission_stats", lambda s, d: a.admission_stats(admitted(s, d)),
    f"""SELECT count(*) AS total_evaluated, count(*) FILTER (act = 'ACCEPT') AS accepted, count(*) FILTER (act = 'DROP_STALE') AS dropped_stale, count(*) FILTER (act = 'DROP_OUT_OF_SESSION') AS dropped_out_of_session, count(*) FILTER (act = 'REJECT_MALFORMED') AS rejected_malformed,
    count(*) FILTER (act = 'ACCEPT') * 100.0 / count(*) AS acceptance_rate_pct FROM (SELECT {ACT} AS act FROM adm)""", "", "total_evaluated accepted dropped_stale dropped_out_of_session rejected_malformed acceptance_rate_pct", adm=ADM)

# --- bars ------------------------------------------------------------------------------------------
BAR = "arg_min(ltp, row(exchange_timestamp, event_id)) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, row(exchange_timestamp, event_id)) AS close, CAST(sum(last_traded_qty) AS BIGINT) AS volume, sum(ltp * last_traded_qty) AS turnover, count(*) AS tick_count"
BARN = "open high low close volume turnover tick_count"


def minute(df):
    return df.withColumn("minute", F.date_format("timestamp", "yyyy-MM-dd HH:mm"))


add("s08_tick_bars", lambda s, d: minute(b.resample_ticks(good(s, d), "30m")), f"SELECT symbol, strftime(time_bucket(INTERVAL 30 MINUTE, exchange_timestamp), '%Y-%m-%d %H:%M') AS minute, {BAR} FROM ({GOOD}) GROUP BY 1, 2", "symbol minute", BARN)


def workspace(s) -> str:
    return os.path.join(ensure_checkpoint_dir(s), f"stream-{uuid.uuid4().hex}")


def tick_stream(s, d):
    """The event files as a stream of priced ticks."""
    fields = fx.table(s, d, "events").schema
    raw = s.readStream.schema(fields).parquet(f"{d}/events*.parquet")
    return raw.withColumn("value", F.greatest("value", F.lit(0.01))).select(
        "event_id", F.col("user_id").cast("string").alias("token"), F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.lit("X").alias("exchange"), F.col("ts").cast("timestamp").alias("exchange_timestamp"),
        F.col("event_id").alias("sequence_number"), F.col("value").alias("ltp"), F.get_json_object("props", "$.k").cast("long").alias("last_traded_qty"), F.lit(0).cast("long").alias("cumulative_volume"), F.col("ts").cast("timestamp").alias("received_at"))


def drained(s, writer_of):
    """Run a stream over everything available and read back what it wrote."""
    base = workspace(s)
    query = writer_of(f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{base}/out")


def stream_bars(timeframe: str):
    def build(s, d):
        bars = b.tick_bars(tick_stream(s, d), timeframe)
        return minute(drained(s, lambda out, check: sinks.sink_bars(bars, out, check).outputMode("append")))
    return build


CLOSED = "(SELECT max(exchange_timestamp) - INTERVAL 2 SECOND FROM ticks)"
add("s08_tick_bars_stream", stream_bars("30m"),
    f"SELECT * FROM (SELECT symbol, strftime(time_bucket(INTERVAL 30 MINUTE, exchange_timestamp), '%Y-%m-%d %H:%M') AS minute, max(time_bucket(INTERVAL 30 MINUTE, exchange_timestamp)) AS st, {BAR} FROM ({GOOD}) GROUP BY 1, 2) WHERE st + INTERVAL 30 MINUTE <= {CLOSED}",
    "symbol minute", "open high low close volume tick_count")
add("s09_volume_deltas", lambda s, d: b.volume_deltas(good(s, d)),
    f"""SELECT event_id, CASE WHEN base IS NULL THEN last_traded_qty ELSE greatest(cumulative_volume - base, 0) END AS volume_delta FROM (SELECT *, max(cumulative_volume) OVER (PARTITION BY symbol, session_date ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM ({GOOD}))""",
    "event_id", "volume_delta")
add("s11_close_elapsed", lambda s, d: minute(b.close_elapsed(b.resample_ticks(good(s, d), "30m"), F.lit("2024-01-10 12:00:00").cast("timestamp"), "30m")),
    f"SELECT symbol, strftime(st, '%Y-%m-%d %H:%M') AS minute, TIMESTAMP '2024-01-10 11:59:58' >= st + INTERVAL 30 MINUTE AS is_final FROM (SELECT DISTINCT symbol, time_bucket(INTERVAL 30 MINUTE, exchange_timestamp) AS st FROM ({GOOD}))", "symbol minute is_final")
add("s12_current_bar", lambda s, d: minute(b.current_bar(good(s, d), "1h")),
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY minute DESC) AS rn, false AS is_final FROM (SELECT symbol, strftime(time_bucket(INTERVAL 1 HOUR, exchange_timestamp), '%Y-%m-%d %H:%M') AS minute, {BAR} FROM ({GOOD}) GROUP BY 1, 2)) WHERE rn = 1", "symbol minute is_final", BARN)
add("s13_daily_bars", lambda s, d: minute(b.resample_ticks(good(s, d), "1d")),
    f"SELECT symbol, strftime(CAST(exchange_timestamp + INTERVAL 330 MINUTE AS DATE) + INTERVAL 225 MINUTE, '%Y-%m-%d %H:%M') AS minute, {BAR} FROM ({GOOD}) GROUP BY 1, 2", "symbol minute", BARN)
add("s14_sequence_gaps", lambda s, d: b.sequence_gaps(fx.ticks(s, d)),
    """SELECT event_id, coalesce(sequence_number <= top, false) AS is_duplicate, coalesce(greatest(sequence_number - top - 1, 0), 0) AS gap_size, coalesce(sequence_number - top > 1, false) AS is_gap FROM (
    SELECT *, max(sequence_number) OVER (PARTITION BY exchange, token ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ticks)""", "event_id is_duplicate is_gap", "gap_size")


@contextmanager
def rocksdb(s):
    """The state store that keyed state needs, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    s.conf.set(name, a.ROCKSDB)
    try:
        yield
    finally:
        s.conf.set(name, before)


def volume_stream(s, d):
    """The day's volume grows by the traded quantity; every 13th tick is late with a smaller one."""
    volume = F.when(F.col("event_id") % 13 == 0, 1).otherwise(F.col("event_id") * 10)
    with rocksdb(s):
        deltas = b.volume_deltas_stream(tick_stream(s, d).withColumn("cumulative_volume", volume))
        return drained(s, lambda out, check: sinks.sink_upsert(deltas, out, ("event_id",), check).outputMode("append"))


add("s09_stream", volume_stream,
    """SELECT event_id, CASE WHEN base IS NULL THEN k ELSE greatest(v - base, 0) END AS volume_delta FROM (SELECT event_id, k, v, max(v) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM (
    SELECT *, greatest(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CASE WHEN event_id % 13 = 0 THEN 1 ELSE event_id * 10 END AS v FROM events))""", "event_id", "volume_delta")


def replayed(s, ticks, by, writer_of, slices=3):
    """Feed all ticks as successive micro-batches of ascending ``by`` to one stream that stops and restarts between them."""
    base = workspace(s)
    at = F.unix_micros(by)
    low, high = ticks.agg(F.min(at), F.max(at)).first()
    cut = F.floor((at - F.lit(low)) * slices / F.lit(high - low + 1))
    ticks.withColumn("_slice", cut).write.partitionBy("_slice").parquet(f"{base}/slices")  # the ticks are derived once
    parts = s.read.parquet(f"{base}/slices")
    with rocksdb(s):
        for i in range(slices):
            parts.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(f"{base}/in")
            stream = s.readStream.schema(ticks.schema).parquet(f"{base}/in")
            writer_of(stream, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


def kept(operator, keys):
    return lambda stream, out, check: sinks.sink_upsert(operator(stream), out, keys, check).outputMode("append")


add("s05_stream", lambda s, d: replayed(s, good(s, d), "received_at", kept(lambda t: a.admit_stateful(t, a.AdmissionPolicy(max_price_velocity=0.5)), ("token", "event_id"))),
    "SELECT t.token, event_id, action, gap AS reasons FROM state_rec r JOIN state_rows t ON t.token = r.token AND t.srn = r.srn", "token event_id action reasons", state_rows=STATE_ROWS, state_rec=STATE_REC)
add("s14_stream", lambda s, d: replayed(s, fx.ticks(s, d), "received_at", kept(b.sequence_gaps_stream, ("event_id",))),
    """SELECT event_id, coalesce(sequence_number <= top, false) AS is_duplicate, coalesce(greatest(sequence_number - top - 1, 0), 0) AS gap_size, coalesce(sequence_number - top > 1, false) AS is_gap FROM (
    SELECT *, max(sequence_number) OVER (PARTITION BY exchange, token ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ticks)""", "event_id is_duplicate is_gap", "gap_size")


def snapshot_bars(s, d):
    versions = replayed(s, good(s, d), "exchange_timestamp", lambda stream, out, check: sinks.sink_snapshot(b.tick_bars(stream, "1h"), out, check))
    bars = sinks.newest(versions, ("symbol", "timestamp"))
    values = [c for c in bars.columns if c not in ("symbol", "timestamp")]
    last = bars.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"), F.max_by(F.struct(*values), "timestamp").alias("_b"))
    return minute(last.select("symbol", "timestamp", "_b.*"))


add("s12_stream", snapshot_bars,
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY minute DESC) AS rn FROM (SELECT symbol, strftime(time_bucket(INTERVAL 1 HOUR, exchange_timestamp), '%Y-%m-%d %H:%M') AS minute, {BAR} FROM ({GOOD}) GROUP BY 1, 2)) WHERE rn = 1",
    "symbol minute", "open high low close volume tick_count")
add("s13_stream", lambda s, d: minute(drained(s, lambda out, check: sinks.sink_bars(b.tick_bars(tick_stream(s, d), "1d"), out, check).outputMode("append"))),
    f"""SELECT symbol, strftime(st, '%Y-%m-%d %H:%M') AS minute, open, high, low, close, volume, tick_count FROM (
    SELECT symbol, time_bucket(INTERVAL 1 DAY, exchange_timestamp - INTERVAL 225 MINUTE) + INTERVAL 225 MINUTE AS st, {BAR} FROM ({GOOD}) GROUP BY 1, 2) WHERE st + INTERVAL 1 DAY <= {CLOSED}""",
    "symbol minute", "open high low close volume tick_count")


def repeated_stream(s, d):
    """Every third tick arrives twice in its micro-batch."""
    t = tick_stream(s, d)
    twice = t.withColumn("n", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("n")
    with rocksdb(s):
        return drained(s, lambda out, check: a.dedup(twice).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)).groupBy("token").agg(F.count(F.lit(1)).alias("ticks"))


add("s04_stream", repeated_stream, f"SELECT token, count(*) AS ticks FROM ({GOOD}) GROUP BY 1", "token", "ticks")


def gap_events(s, d):
    e = F.col("event_id")
    minutes = F.when(e % 10 == 0, e % 90).otherwise(0).cast("int")  # most gaps close at once
    return fx.ticks(s, d).select("symbol", F.col("exchange_timestamp").alias("start_time"), F.when(e % 400 != 0, F.col("exchange_timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("end_time"),
                                                       F.when(e % 30 == 0, "REPAIRED").otherwise("UNREPAIRED").alias("status"))


GAPS = "SELECT symbol, exchange_timestamp AS st, CASE WHEN event_id % 400 <> 0 THEN exchange_timestamp + CASE WHEN event_id % 10 = 0 THEN event_id % 90 ELSE 0 END * INTERVAL 1 MINUTE END AS et FROM ticks WHERE event_id % 30 <> 0"
add("s15_mark_untrusted", lambda s, d: minute(b.mark_untrusted(b.resample_ticks(good(s, d), "30m"), gap_events(s, d), "30m")),
    f"""SELECT symbol, strftime(ws, '%Y-%m-%d %H:%M') AS minute, CASE WHEN EXISTS (SELECT 1 FROM gap_rows g WHERE g.symbol = w.symbol AND g.st < w.ws + INTERVAL 30 MINUTE AND (g.et IS NULL OR (g.et > w.ws AND g.et > g.st))) THEN 'UNTRUSTED' ELSE 'TRUSTED' END AS quality_status
    FROM (SELECT DISTINCT symbol, time_bucket(INTERVAL 30 MINUTE, exchange_timestamp) AS ws FROM ({GOOD})) w""", "symbol minute quality_status", gap_rows=GAPS)
def trusted_stream(s, d):
    bars = b.mark_untrusted(b.tick_bars(tick_stream(s, d), "30m"), gap_events(s, d), "30m")
    return minute(drained(s, lambda out, check: sinks.sink_bars(bars, out, check).outputMode("append")))


add("s15_stream", trusted_stream,
    f"""SELECT symbol, strftime(ws, '%Y-%m-%d %H:%M') AS minute, CASE WHEN EXISTS (SELECT 1 FROM gap_rows g WHERE g.symbol = w.symbol AND g.st < w.ws + INTERVAL 30 MINUTE AND (g.et IS NULL OR (g.et > w.ws AND g.et > g.st))) THEN 'UNTRUSTED' ELSE 'TRUSTED' END AS quality_status
    FROM (SELECT DISTINCT symbol, time_bucket(INTERVAL 30 MINUTE, exchange_timestamp) AS ws FROM ({GOOD})) w WHERE ws + INTERVAL 30 MINUTE <= {CLOSED}""", "symbol minute quality_status", gap_rows=GAPS)
add("s16_latency_stats", lambda s, d: b.latency_stats(good(s, d).withColumn("latency_ms", F.col("ltp") * (1 + F.col("event_id") % 7)), ("token",)),
    f"""SELECT token, n AS count, max(v) AS max, max(v) FILTER (rk = floor(n * 0.5)) AS p50, max(v) FILTER (rk = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(v) FILTER (rk = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM (
    SELECT token, ltp * (1 + event_id % 7) AS v, row_number() OVER (PARTITION BY token ORDER BY ltp * (1 + event_id % 7)) - 1 AS rk, count(*) OVER (PARTITION BY token) AS n FROM ({GOOD})) GROUP BY 1, 2""", "token", "count max p50 p95 p99")
add("s17_resample", lambda s, d: minute(b.resample(b.resample_ticks(good(s, d), "5m"), "1h")),
    f"SELECT symbol, strftime(time_bucket(INTERVAL 1 HOUR, exchange_timestamp), '%Y-%m-%d %H:%M') AS minute, {BAR} FROM ({GOOD}) GROUP BY 1, 2", "symbol minute", "open high low close volume")


def sink_dead(s, d):
    failed = tick_stream(s, d).withColumn("error", F.when(F.col("event_id") % 9 == 0, "WRITE_FAILED").otherwise("DECODE_FAILED"))
    return drained(s, lambda out, check: sinks.sink_dead_letter(failed, out, check)).withColumn("event_id", F.get_json_object("payload_json", "$.event_id").cast("long"))


add("io17_sink_dead_letter", sink_dead, "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'WRITE_FAILED' ELSE 'DECODE_FAILED' END AS error FROM events", "event_id error")
add("io16_sink_ticks", lambda s, d: drained(s, lambda out, check: sinks.sink_ticks(tick_stream(s, d), out, check)), "SELECT event_id, greatest(value, 0.01::DOUBLE) AS ltp FROM events", "event_id", "ltp")
