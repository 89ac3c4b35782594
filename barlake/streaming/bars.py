"""Bars from ticks: tumbling windows on event time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlake.functions.windows import Running, count_below, scan
from barlake.operators.metrics import at_rank, value_ranks

# Supported bar lengths in seconds.
TIMEFRAME_SECONDS = {
    "1s": 1, "5s": 5, "10s": 10, "15s": 15, "30s": 30, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "1d": 86400,
}
LOCAL_TZ = "Asia/Kolkata"


def bar_start(ts: Column, timeframe: str) -> Column:
    """Start of the bar: epoch-aligned; daily bars start at 09:15 local of the local date."""
    if timeframe == "1d":
        local = F.date_trunc("day", F.from_utc_timestamp(ts, LOCAL_TZ))
        return F.to_utc_timestamp(local + F.expr("INTERVAL '9' HOUR + INTERVAL '15' MINUTE"), LOCAL_TZ)
    seconds = TIMEFRAME_SECONDS[timeframe]
    return F.timestamp_seconds(F.floor(ts.cast("double") / seconds) * seconds)


def _aggregates(at: Column, order: Column) -> list[Column]:
    return [
        F.min_by("ltp", order).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", order).alias("close"),
        F.sum("_qty").cast("long").alias("volume"), F.sum(F.col("ltp") * F.col("_qty")).alias("turnover"), F.count(F.lit(1)).alias("tick_count"),
    ]


def resample_ticks(ticks: DataFrame, timeframe: str, quantity: str = "last_traded_qty") -> DataFrame:
    """Batch bars from ticks; open and close follow (event time, arrival order)."""
    order = F.struct("exchange_timestamp", "event_id") if "event_id" in ticks.columns else F.struct("exchange_timestamp", "sequence_number")
    df = ticks.withColumns({"timestamp": bar_start(F.col("exchange_timestamp"), timeframe), "_qty": F.col(quantity)})
    bars = df.groupBy("symbol", "exchange", "timestamp").agg(*_aggregates(F.col("exchange_timestamp"), order))
    return bars.withColumn("timeframe", F.lit(timeframe))


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Larger bars from smaller ones with the same floor rule."""
    df = bars.withColumn("_start", bar_start(F.col("timestamp"), timeframe))
    return df.groupBy("symbol", "_start").agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars"),
    ).withColumnRenamed("_start", "timestamp").withColumn("timeframe", F.lit(timeframe))


# --- streams ------------------------------------------------------------------------------------

def tick_bars(ticks: DataFrame, timeframe: str, lateness: str = "2 seconds") -> DataFrame:
    """Tumbling bars of a tick stream; a bar is final when the watermark passes its end.

    Rows without a price are heartbeats: they move the watermark and close idle windows but
    add nothing to a bar.  Daily bars start at 09:15 local.
    """
    seconds = TIMEFRAME_SECONDS[timeframe]
    start = "3 hours 45 minutes" if timeframe == "1d" else "0 seconds"
    order = F.struct("exchange_timestamp", "sequence_number")
    df = ticks.withWatermark("exchange_timestamp", lateness).withColumn("_qty", F.col("last_traded_qty"))
    grouped = df.groupBy(F.window("exchange_timestamp", f"{seconds} seconds", startTime=start).alias("_w"), "symbol", "exchange")
    real = F.when(F.col("ltp").isNotNull(), order)
    bars = grouped.agg(
        F.min_by("ltp", real).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", real).alias("close"),
        F.sum(F.when(F.col("ltp").isNotNull(), F.col("_qty"))).cast("long").alias("volume"), F.count("ltp").alias("tick_count"))
    return bars.filter("tick_count > 0").select(
        "symbol", "exchange", F.col("_w.start").alias("timestamp"), F.col("_w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "tick_count",
        F.lit(timeframe).alias("timeframe"))


def with_heartbeats(ticks: DataFrame, beats: DataFrame) -> DataFrame:
    """Union a clock stream (exchange_timestamp only) so that silence still closes windows."""
    beat = beats.select(*[
        F.col("exchange_timestamp") if f.name == "exchange_timestamp" else F.lit("__CLOCK__").alias("symbol") if f.name == "symbol"
        else F.lit(None).cast(f.dataType).alias(f.name) for f in ticks.schema.fields])
    return ticks.unionByName(beat)


def close_elapsed(bars: DataFrame, now: Column, timeframe: str, lateness_seconds: float = 2.0) -> DataFrame:
    """``is_final`` of stored bars at ``now``: the timer rule."""
    end = F.col("timestamp").cast("double") + TIMEFRAME_SECONDS[timeframe]
    return bars.withColumn("is_final", now.cast("double") - lateness_seconds >= end)


def current_bar(ticks: DataFrame, timeframe: str) -> DataFrame:
    """The newest, still open bar of every symbol."""
    bars = resample_ticks(ticks, timeframe)
    values = ("exchange", "open", "high", "low", "close", "volume", "turnover", "tick_count")
    newest = bars.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"), F.max_by(F.struct(*values), "timestamp").alias("_b"))
    return newest.select("symbol", "timestamp", "_b.*", F.lit(False).alias("is_final"))


def late_count(progress: list[dict]) -> int:
    """Ticks dropped behind the watermark, from a streaming query's progress reports."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))


# --- tick tables ---------------------------------------------------------------------------------

def volume_deltas(ticks: DataFrame, order: tuple[str, ...] = ("received_at", "event_id")) -> DataFrame:
    """Traded quantity per tick from the cumulative volume of the UTC day.

    The first tick of a day counts its own traded quantity; a late tick counts 0 and never
    lowers the baseline.
    """
    day = F.to_date("exchange_timestamp")
    run = scan(ticks.withColumn("_day", day), ("symbol", "_day"), order, [Running("_base", "max", F.col("cumulative_volume"), inclusive=False)], seconds=3600)
    first = F.greatest(F.col("last_traded_qty"), F.lit(0))
    step = F.greatest(F.col("cumulative_volume") - F.col("_base"), F.lit(0))
    return run.withColumn("volume_delta", F.when(F.col("_base").isNull(), first).otherwise(step)).drop("_day", "_base")


KEPT_DAYS = 3
# Keys share this many groups of a stream, so that a micro-batch costs a few calls of the state store a group, not a key.
SHARDS = 1 << 10


def shard(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).alias("shard")


def _arrivals(rows: Iterator[pd.DataFrame], keys: list[str]) -> pd.DataFrame:
    """A group's rows of one micro-batch in order of arrival, with numbers of its keys in column ``k``."""
    frames = list(rows)
    if not frames:
        return pd.DataFrame()
    pdf = pd.concat(frames, ignore_index=True).sort_values(["received_at", "event_id"], kind="stable", ignore_index=True)
    return pdf.assign(k=pdf.groupby(keys, dropna=False, sort=False).ngroup())


def _tops(key: pd.Series, value: pd.Series, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest earlier value of each row's key, highest of each key in the end); ``known`` has what the state says by key."""
    running = value.groupby(key).cummax()
    before = np.maximum(running.groupby(key).shift(1, fill_value=NONE).to_numpy(), known[key.to_numpy()])
    return before, np.maximum(value.groupby(key).max().to_numpy(), known)


NONE = -(2**63)  # below every value


class _Volume(StatefulProcessor):
    """The highest cumulative volume of each symbol of a group on each of its last KEPT_DAYS days."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tops = handle.getValueState("tops", "symbol array<string>, day array<bigint>, volume array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _arrivals(rows, ["symbol", "day"])
        if pdf.empty:
            return
        symbols, days, volumes = self.tops.get() if self.tops.exists() else ([], [], [])
        stored = dict(zip(zip(symbols, days), volumes))
        first, volume = pdf.drop_duplicates("k"), pdf["cumulative_volume"]
        names = list(zip(first["symbol"].tolist(), first["day"].tolist()))
        before, top = _tops(pdf["k"], volume, np.array([stored.get(n, NONE) for n in names], np.int64))
        gain = np.where(volume.to_numpy() > before, volume.to_numpy() - before, 0)
        yield pd.DataFrame({"event_id": pdf["event_id"], "symbol": pdf["symbol"], "volume_delta": np.where(before == NONE, pdf["last_traded_qty"], gain)})
        stored.update((n, v) for n, v in zip(names, top.tolist()) if v != NONE)
        last: dict[str | None, list[int]] = {}
        for symbol, day in sorted(stored, key=lambda n: n[1]):
            last.setdefault(symbol, []).append(day)
        kept = [(symbol, day) for symbol, known in last.items() for day in known[-KEPT_DAYS:]]
        self.tops.update(([n[0] for n in kept], [n[1] for n in kept], [stored[n] for n in kept]))

    def close(self) -> None:
        pass


def volume_deltas_stream(ticks: DataFrame) -> DataFrame:
    """``volume_deltas`` of a tick stream: (event_id, symbol, volume_delta).

    Ticks of a micro-batch are taken in order of (received_at, event_id).  A late tick counts 0 and never lowers the
    baseline of its day; a symbol keeps the baselines of its last KEPT_DAYS days.  Needs the RocksDB state store.
    """
    day = F.coalesce(F.unix_date(F.to_date("exchange_timestamp")).cast("long"), F.lit(NO_DAY))
    needed = ticks.select(
        shard("symbol"), "event_id", "symbol", day.alias("day"), "received_at", F.greatest("last_traded_qty", F.lit(0)).cast("long").alias("last_traded_qty"),
        F.coalesce(F.col("cumulative_volume").cast("long"), F.lit(NONE)).alias("cumulative_volume"))
    return needed.groupBy("shard").transformWithStateInPandas(_Volume(), "event_id bigint, symbol string, volume_delta bigint", "append", "none")


NO_DAY = -(2**31)  # ticks without a time are a day of their own, as in the table


def sequence_gaps(ticks: DataFrame, keys: tuple[str, ...] = ("exchange", "token"), order: tuple[str, ...] = ("received_at", "event_id")) -> DataFrame:
    """Gap, duplicate and gap size against the highest sequence number seen before in the stream."""
    known = ticks.filter("sequence_number > 0")
    run = scan(known, keys, order, [Running("_top", "max", F.col("sequence_number"), inclusive=False)], seconds=3600)
    size = F.greatest(F.col("sequence_number") - F.col("_top") - 1, F.lit(0))
    return run.withColumns({
        "is_duplicate": F.coalesce(F.col("sequence_number") <= F.col("_top"), F.lit(False)), "gap_size": F.coalesce(size, F.lit(0)),
        "is_gap": F.coalesce(size > 0, F.lit(False))}).drop("_top")


class _Sequence(StatefulProcessor):
    """The highest sequence number of each key of a group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "name array<string>, sequence array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _arrivals(rows, ["name"])
        if pdf.empty:
            return
        stored = dict(zip(*self.top.get())) if self.top.exists() else {}
        names, number = pdf.drop_duplicates("k")["name"].tolist(), pdf["sequence_number"]
        before, top = _tops(pdf["k"], number, np.array([stored.get(n, 0) for n in names], np.int64))  # numbers are positive
        seen = before > 0
        size = np.where(seen, np.maximum(number.to_numpy() - np.where(seen, before, 0) - 1, 0), 0)
        stored.update(zip(names, top.tolist()))
        self.top.update((list(stored), list(stored.values())))
        yield pd.DataFrame({
            "event_id": pdf["event_id"], "symbol": pdf["symbol"], "exchange_timestamp": pdf["exchange_timestamp"],
            "is_duplicate": seen & (number.to_numpy() <= before), "gap_size": size, "is_gap": size > 0})

    def close(self) -> None:
        pass


def sequence_gaps_stream(ticks: DataFrame, keys: tuple[str, ...] = ("exchange", "token")) -> DataFrame:
    """``sequence_gaps`` of a tick stream: (event_id, symbol, exchange_timestamp, is_duplicate, gap_size, is_gap).

    A key's state is one number.  Ticks of a micro-batch are taken in order of (received_at, event_id); ticks without a
    positive sequence number are left out.  Needs the RocksDB state store.
    """
    name = F.to_json(F.struct(*keys)).alias("name")
    known = ticks.filter("sequence_number > 0").select(shard(*keys), name, "event_id", "symbol", "exchange_timestamp", "received_at", "sequence_number")
    schema = "event_id bigint, symbol string, exchange_timestamp timestamp, is_duplicate boolean, gap_size bigint, is_gap boolean"
    return known.groupBy("shard").transformWithStateInPandas(_Sequence(), schema, "append", "none")


def gap_reach(gaps: DataFrame) -> DataFrame:
    """(symbol, starts, reach): the starts of a symbol's unrepaired gaps in order, and how far the gaps up to each reach.

    An open gap reaches past every bar; a closed gap without length has none.  Gaps of one start are one.
    """
    live = gaps.filter("status = 'UNREPAIRED' AND start_time IS NOT NULL AND (end_time IS NULL OR end_time > start_time)")
    end = F.when(F.col("end_time").isNull(), FOREVER).otherwise(F.unix_micros("end_time"))
    each = live.groupBy("symbol", F.unix_micros("start_time").alias("start")).agg(F.max(end).alias("end"))
    listed = each.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("g"))
    grow = lambda out, g: F.concat(out, F.array(F.greatest(g["end"], F.coalesce(F.try_element_at(out, F.lit(-1)), g["end"]))))
    return listed.select("symbol", F.transform("g", lambda g: g["start"]).alias("starts"), F.aggregate("g", F.array().cast("array<bigint>"), grow).alias("reach"))


FOREVER = 2**62


def mark_untrusted(bars: DataFrame, gaps: DataFrame, timeframe: str) -> DataFrame:
    """UNTRUSTED where a bar overlaps an unrepaired gap; ``bars`` may be a stream, ``gaps`` is a table.

    Of the gaps that start before a bar's end, found by binary search, the farthest reach decides, so a long gap costs
    no more than a short one.
    """
    begin = F.unix_micros("timestamp")
    df = bars.join(gap_reach(gaps), "symbol", "left")
    before = count_below(F.col("starts"), begin + TIMEFRAME_SECONDS[timeframe] * 1_000_000)
    bad = F.coalesce(F.try_element_at("reach", F.when(before > 0, before)) > begin, F.lit(False))
    return df.withColumns({"quality_status": F.when(bad, "UNTRUSTED").otherwise("TRUSTED"), "is_authoritative": ~bad}).drop("starts", "reach")


def latency_stats(ticks: DataFrame, keys: tuple[str, ...] = ("exchange",), value: str = "latency_ms", quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank percentiles (row int(n*p)), maximum and count of non-negative latencies."""
    ranked = value_ranks(ticks.filter(F.col(value) >= 0).select(*keys, value), keys, value)
    sizes = ranked.groupBy(*keys).agg(F.sum("_n").alias("count"), F.max(value).alias("max"))
    spot = lambda q: F.least(F.floor(F.col("count") * F.lit(q)), F.col("count") - 1)
    picked = [F.max(at_rank(value, spot(q))).alias(f"p{round(q * 100)}") for q in quantiles]
    return ranked.join(sizes, list(keys)).groupBy(*keys).agg(*picked, F.first("max").alias("max"), F.first("count").alias("count"))
