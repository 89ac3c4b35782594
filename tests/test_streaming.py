"""Streams of small hand-made files: late, repeated, missing and jumping ticks."""

import json
import os
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.streaming import admission as a
from barlake.streaming import bars as b
from barlake.streaming import packets as pk
from barlake.streaming import sinks

SCHEMA = (
    "event_id bigint, token string, symbol string, exchange string, exchange_timestamp timestamp, received_at timestamp, sequence_number bigint, "
    "ltp double, last_traded_qty bigint, cumulative_volume bigint"
)


def tick(i, at, price=100.0, seq=None, volume=None, token="T"):
    when = lambda s: (pd.Timestamp("2024-01-03 04:00:00", tz="UTC") + pd.Timedelta(seconds=s)).to_pydatetime()
    return (i, token, f"S{token}", "X", when(at), when(i), seq if seq is not None else i, price, 1, volume if volume is not None else 10 * i)


def files(path, *batches):
    path.mkdir()
    for n, rows in enumerate(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        text = "\n".join(json.dumps({k: (f"{v:%Y-%m-%d %H:%M:%S}" if isinstance(v, datetime) else v) for k, v in zip(names, r)}) for r in rows)
        (path / f"{n}.json").write_text(text)
        os.utime(path / f"{n}.json", (1_700_000_000 + 10 * n,) * 2)  # files are read in order of age
    return str(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(path)


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_bars_close_by_watermark_and_drop_late_ticks(spark, tmp_path):
    path = files(tmp_path / "in", [tick(1, 5, 10.0), tick(2, 50, 12.0)], [tick(3, 30, 9.0), tick(4, 200, 20.0)], [tick(5, 201, 20.0)], [tick(6, 10, 99.0), tick(7, 400, 21.0)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    query = drain(sinks.sink_bars(b.tick_bars(source(spark, path), "1m"), out, check).outputMode("append"))
    got = {r.timestamp.minute: (r.open, r.high, r.low, r.close, r.tick_count) for r in spark.read.parquet(out).collect()}
    assert got[0] == (10.0, 12.0, 9.0, 12.0, 3)
    assert got[3] == (20.0, 20.0, 20.0, 20.0, 2) and 6 not in got
    assert b.late_count([json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]) == 1


def test_heartbeats_close_idle_windows(spark, tmp_path):
    ticks = source(spark, files(tmp_path / "in", [tick(1, 5)], [tick(2, 6)]))
    beats = source(spark, files(tmp_path / "beats", [tick(1, 10)], [tick(2, 900)])).select("exchange_timestamp")
    bars = b.tick_bars(b.with_heartbeats(ticks, beats), "1m")
    drain(sinks.sink_bars(bars, str(tmp_path / "out"), str(tmp_path / "check")).outputMode("append"))
    assert [(r.symbol, r.tick_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("ST", 2)]


ODD = [
    [tick(1, 1, 100.0), tick(2, 2, 101.0), tick(3, 3, 101.0, seq=5), tick(4, 4, 150.0, seq=6)],
    [tick(5, 5, 101.5, seq=5), tick(6, 1, 101.0, seq=7), tick(7, 6, 101.0, seq=8, volume=1), tick(8, 7, 102.0, seq=9), tick(9, 8, 50.0, seq=1, token="U")],
]
WANT = {
    1: ("ACCEPT", "VALID_TICK"), 2: ("ACCEPT", "VALID_TICK"), 3: ("ACCEPT", "SEQUENCE_GAP_DETECTED,VALID_TICK"), 4: ("QUARANTINE", "EXTREME_PRICE_VELOCITY"),
    5: ("DROP_DUPLICATE", "DUPLICATE_SEQUENCE_NUMBER"), 6: ("DROP_STALE", "SEQUENCE_GAP_DETECTED,OUT_OF_ORDER_TIMESTAMP"),
    7: ("QUARANTINE", "SEQUENCE_GAP_DETECTED,CUMULATIVE_VOLUME_DECREASE"), 8: ("ACCEPT", "SEQUENCE_GAP_DETECTED,VALID_TICK"), 9: ("ACCEPT", "VALID_TICK"),
}


def verdicts(df):
    return {r.event_id: (r.action, r.reasons) for r in df.collect()}


def test_batch_admission(spark):
    rows = spark.createDataFrame([r for part in ODD for r in part], SCHEMA)
    assert verdicts(a.admit_batch(rows)) == WANT


def test_stream_admission_equals_batch_and_routes_rows(spark, tmp_path):
    stream = a.admit_stateful(source(spark, files(tmp_path / "in", *ODD)))
    good, held = str(tmp_path / "good"), str(tmp_path / "held")
    drain(sinks.sink_admission(stream, good, held, str(tmp_path / "check")))
    kept, aside = spark.read.parquet(good), spark.read.parquet(held)
    assert verdicts(kept) | verdicts(aside) == WANT
    assert {r.event_id for r in aside.collect()} == {4, 5, 6, 7} and all("event_id" in r.raw_payload_json for r in aside.collect())


def test_stream_dedup(spark, tmp_path):
    once = a.dedup(source(spark, files(tmp_path / "in", [tick(1, 1), tick(2, 2)], [tick(1, 1), tick(3, 3)])))
    drain(sinks.sink_upsert(once, str(tmp_path / "out"), ("event_id", "received_at"), str(tmp_path / "check")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_replayed_batch_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame(ODD[0], SCHEMA)
    write = sinks.upsert_batch(str(tmp_path / "t"), ("token", "event_id"))
    write(rows, 0)
    write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(ODD[0])


def test_sink_reads_only_the_days_of_its_batch(spark, tmp_path):
    row = lambda i, day: (i, f"2024-01-0{day} 04:00:00")
    frame = lambda *rows: spark.createDataFrame([*rows], "event_id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    path, write = tmp_path / "t", sinks.upsert_batch(str(tmp_path / "t"), ("event_id", "at"), F.col("at"))
    write(frame(row(1, 3), row(2, 4), row(3, 5), (9, None)), 0)
    for file in (path / "key_day=2024-01-05").rglob("*.parquet"):
        file.write_bytes(b"unreadable")
    write(frame(row(1, 3), row(4, 3), row(5, 4), (9, None)), 1)
    write(frame(row(1, 3), row(4, 3), row(5, 4), (9, None)), 1)
    kept = spark.read.option("basePath", str(path)).parquet(*[str(path / f"key_day={d}") for d in ("2024-01-03", "2024-01-04")])
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 4, 5]
    with pytest.raises(Exception):
        write(frame(row(3, 5)), 2)


def test_percentiles_with_a_value_that_many_rows_share(spark):
    values = [5.0] * 400 + [float(i % 97) for i in range(800)]
    ticks = spark.createDataFrame([("N", v) for v in values] + [("M", 2.0), ("M", -1.0), ("L", None)], "exchange string, latency_ms double")
    got = {r.exchange: r for r in b.latency_stats(ticks).collect()}
    ordered = sorted(values)
    assert [got["N"][c] for c in ("p50", "p95", "p99", "max", "count")] == [ordered[600], ordered[1140], ordered[1188], 96.0, 1200]
    assert set(got) == {"N", "M"} and got["M"]["p50"] == 2.0 and got["M"]["count"] == 1


def test_packet_faults(spark):
    raw = spark.createDataFrame([(1, bytearray(b"\x01")), (2, bytearray(b"\x09\x00")), (3, bytearray(b"\x01" + b"\x00" * 49)), (4, bytearray(b"\x01\x01" + b"77".ljust(25, b"\x00") + (5).to_bytes(8, "little") + (1_700_000_000_000).to_bytes(8, "little") + (12345).to_bytes(8, "little")))], "packet_id bigint, payload binary")
    got = {r.packet_id: r for r in pk.decode_packets(raw).collect()}
    assert [got[i].error for i in (1, 2, 3)] == ["PACKET_TOO_SHORT", "UNKNOWN_MODE", "INVALID_PACKET_SIZE"]
    assert (got[4].token, got[4].exchange, got[4].ltp, got[4].sequence_number) == ("77", "NSE_CM", 123.45, 5)


@pytest.mark.parametrize("timeframe, minute", [("5m", 5), ("1d", 45)])
def test_bar_start(spark, timeframe, minute):
    row = spark.range(1).select(b.bar_start(F.lit("2024-01-03 04:08:59").cast("timestamp"), timeframe).alias("t")).first()
    assert row.t.minute == minute


def test_volume_stream_keeps_its_baseline_over_late_ticks(spark, tmp_path):
    path = files(tmp_path / "in", [tick(1, 1, volume=100), tick(2, 2, volume=130)], [tick(3, 1, volume=90), tick(4, 3, volume=150)], [tick(5, 4, volume=140), tick(6, 5, volume=151)])
    out = str(tmp_path / "out")
    drain(sinks.sink_upsert(b.volume_deltas_stream(source(spark, path)), out, ("event_id",), str(tmp_path / "check")).outputMode("append"))
    assert {r.event_id: r.volume_delta for r in spark.read.parquet(out).collect()} == {1: 1, 2: 30, 3: 0, 4: 20, 5: 0, 6: 1}


def test_gaps_mark_bars_by_their_reach(spark):
    at = lambda m: (pd.Timestamp("2024-01-03 04:00:00", tz="UTC") + pd.Timedelta(minutes=m)).to_pydatetime()
    gaps = spark.createDataFrame([("A", at(1), at(50), "UNREPAIRED"), ("A", at(5), at(6), "UNREPAIRED"), ("A", at(70), at(70), "UNREPAIRED"), ("A", at(80), at(90), "REPAIRED"), ("A", at(120), None, "UNREPAIRED"), ("B", at(0), at(10), "UNREPAIRED")], "symbol string, start_time timestamp, end_time timestamp, status string")
    bars = spark.createDataFrame([(s, at(m)) for s in "ABC" for m in (0, 10, 40, 50, 70, 80, 110, 120, 600)], "symbol string, timestamp timestamp")
    bad = {(r.symbol, r.timestamp.hour * 60 + r.timestamp.minute - 240) for r in b.mark_untrusted(bars, gaps, "5m").where("NOT is_authoritative").collect()}
    assert bad == {("A", 0), ("A", 10), ("A", 40), ("A", 120), ("A", 600), ("B", 0)}, bad
    assert b.mark_untrusted(bars, gaps.limit(0), "5m").where("is_authoritative").count() == 27


def test_depth_snapshots_need_no_price(spark):
    book = "array<struct<price:double,quantity:bigint>>"
    rows = [(1, "T", None, [(9.0, 1)], [(10.0, 1)]), (2, "T", None, [(11.0, 1)], [(10.0, 1)]), (3, "T", None, [(9.0, -1)], [(10.0, 1)]), (4, "T", None, None, [(10.0, 1)]), (5, "T", 9.5, [(0.0, 1)], [(10.0, 1)]), (6, "T", 9.5, None, None)]
    at = F.lit("2024-01-03 04:00:00").cast("timestamp")
    ticks = spark.createDataFrame(rows, f"event_id bigint, token string, ltp double, bids {book}, asks {book}").withColumns({"exchange": F.lit("NSE"), "exchange_timestamp": at, "received_at": at, "cumulative_volume": F.lit(1)})
    assert {r.event_id: (r.action, r.reason) for r in a.admit(ticks).collect()} == {
        1: ("ACCEPT", "VALID_TICK"), 2: ("QUARANTINE", "CROSSED_BOOK_BID_GE_ASK"), 3: ("REJECT_MALFORMED", "INVALID_DEPTH_QUANTITY"), 4: ("REJECT_MALFORMED", "PRICE_NON_FINITE"), 5: ("REJECT_MALFORMED", "INVALID_DEPTH_PRICE"), 6: ("ACCEPT", "VALID_TICK")}


def test_stream_state_holds_many_keys_in_few_groups(spark, tmp_path, monkeypatch):
    """Tokens of one group keep their own state over micro-batches; the store is asked a group at a time."""
    monkeypatch.setattr(b, "SHARDS", 2)
    tokens = [f"T{i}" for i in range(20)]
    one = [tick(100 * i + 1, 1, seq=1, volume=50 + i, token=t) for i, t in enumerate(tokens)] + [tick(9001, 1, seq=3, volume=5, token=None)]
    two = [tick(100 * i + 2, 2, seq=1 + i, volume=60 + 2 * i, token=t) for i, t in enumerate(tokens)] + [tick(9002, 2, seq=9, volume=7, token=None), tick(100 * 5 + 1, 1, seq=1, volume=55, token="T5")]
    path = files(tmp_path / "in", one, two)
    read = lambda name: spark.read.parquet(str(tmp_path / name)).collect()
    drain(sinks.sink_upsert(b.volume_deltas_stream(source(spark, path)), str(tmp_path / "v"), ("event_id",), str(tmp_path / "cv")))
    volumes = {r.event_id: r.volume_delta for r in read("v")}
    assert volumes == {100 * i + 1: 1 for i in range(20)} | {100 * i + 2: 10 + i for i in range(20)} | {9001: 1, 9002: 2}
    drain(sinks.sink_upsert(b.sequence_gaps_stream(source(spark, path)), str(tmp_path / "g"), ("event_id",), str(tmp_path / "cg")))
    gaps = {r.event_id: (r.is_duplicate, r.gap_size) for r in read("g")}
    assert [gaps[100 * i + 2] for i in range(20)] == [(i == 0, max(i - 1, 0)) for i in range(20)] and gaps[9002] == (False, 5)
    judged = a.admit_stateful(source(spark, path))
    drain(judged.writeStream.format("parquet").option("path", str(tmp_path / "a")).option("checkpointLocation", str(tmp_path / "ca")))
    rows = read("a")
    assert len(rows) == 43 and [r.reasons for r in rows if r.event_id == 501 and r.action != "ACCEPT"] == ["DUPLICATE_TICK_FINGERPRINT"]
    assert {r.event_id for r in rows if r.action == "DROP_DUPLICATE"} == {2, 501}


class _Counted(dict):
    """A map of the state store that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_fingerprints_are_read_for_late_ticks_only():
    store, hour = _Counted(), 3_600_000_000
    first = a._Prints(store, "T", 0, -(2**63), [])
    for n, day in ((1, 7), (2, 7), (30, 8), (30.5, 8)):
        at = int(n * hour)
        assert not first.known(f"1:{at}:1.0000:1", day, at)
        first.add(f"1:{at}:1.0000:1", day, at)
    hours = first.close(8)
    assert hours == [a.OTHER, 30] and store.calls == 2  # two hours' writes for four ticks, nothing read
    same = a._Prints(store, "T", 8, first.newest, hours)
    late = lambda n: f"1:{int(n * hour)}:1.0000:1"
    assert same.known(late(30), 8, 30 * hour) and same.known(late(1), 7, hour) and not same.known(late(3), 7, 3 * hour)
    same.add(late(33), 9, 33 * hour)
    assert same.close(9) == [33] and list(store) == [("T", 33)]
