"""Tick admission: stateless rules, book checks, and the per-token state machine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlake.operators.features import LOCAL_TZ, session_date
from barlake.streaming.bars import shard


@dataclass(frozen=True)
class AdmissionPolicy:
    """Default limits of the feed gate."""

    max_future_skew_seconds: float = 1.0
    max_stale_seconds: float = 5.0
    max_price_velocity: float = 0.10
    out_of_order_ms: float = 500.0
    check_session: bool = True
    allowed_exchanges: tuple[str, ...] = (
        "NSE", "BSE", "NFO", "BFO", "MCX", "NSE_CM", "NSE_FO", "BSE_CM", "BSE_FO", "MCX_FO", "NCX_FO", "CDE_FO", "CDS", "NCDEX",
    )
    allowed_tokens: tuple[str, ...] = ()


ACCEPT, MALFORMED, STALE, CLOSED, DUPLICATE, QUARANTINE = (
    "ACCEPT", "REJECT_MALFORMED", "DROP_STALE", "DROP_OUT_OF_SESSION", "DROP_DUPLICATE", "QUARANTINE",
)


BOOK_FAULTS = {"INVALID_DEPTH_PRICE": MALFORMED, "INVALID_DEPTH_QUANTITY": MALFORMED, "INVALID_DEPTH_ORDERING": QUARANTINE, "CROSSED_BOOK_BID_GE_ASK": QUARANTINE}


def book_fault(bids: str = "bids", asks: str = "asks") -> Column:
    """First fault of a depth book, or NULL: bid levels, then ask levels, then a crossed top."""

    def side(name: str, worse) -> Column:
        def code(level: Column, i: Column) -> Column:
            before = F.get(F.col(name), i - 1)["price"]
            return (
                F.when(F.coalesce(level["price"], F.lit(0.0)) <= 0, "INVALID_DEPTH_PRICE").when(level["quantity"] < 0, "INVALID_DEPTH_QUANTITY")
                .when((i > 0) & worse(level["price"], before), "INVALID_DEPTH_ORDERING")
            )
        return F.get(F.array_compact(F.transform(name, code)), F.lit(0))

    rising, falling = side(bids, lambda p, b: p > b), side(asks, lambda p, b: p < b)
    top = lambda name: F.get(F.col(name), F.lit(0))["price"]
    crossed = F.when(top(bids) >= top(asks), "CROSSED_BOOK_BID_GE_ASK")
    both = (F.size(bids) > 0) & (F.size(asks) > 0)
    return F.when(both, F.coalesce(rising, falling, crossed))


def check_book(ticks: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    df = ticks.withColumn("book_fault", book_fault(bids, asks))
    broken = F.col("book_fault").isin("INVALID_DEPTH_PRICE", "INVALID_DEPTH_QUANTITY")
    return df.withColumn("book_action", F.when(F.col("book_fault").isNull(), ACCEPT).when(broken, MALFORMED).otherwise(QUARANTINE))


def admit(ticks: DataFrame, calendar: DataFrame | None = None, policy: AdmissionPolicy = AdmissionPolicy()) -> DataFrame:
    """``action`` and ``reason`` by the first stateless rule that fails; works on streams (static calendar join).

    With columns ``bids`` and ``asks`` a row that has both but no ``ltp`` is a depth snapshot: its book is judged
    instead of a price and a volume.  A row with price and books must pass both.
    """
    c = F.col
    blank = lambda name: c(name).isNull() | (F.trim(c(name).cast("string")) == "")
    at, got = c("exchange_timestamp"), c("received_at")
    lag = got.cast("double") - at.cast("double")
    checks: list[tuple[Column, str, str]] = [
        (blank("token"), MALFORMED, "MISSING_TOKEN"), (blank("exchange"), MALFORMED, "MISSING_EXCHANGE"),
        (at.isNull(), MALFORMED, "MISSING_EXCHANGE_TIMESTAMP"),
    ]
    if policy.allowed_tokens:
        checks.append((~c("token").isin(*policy.allowed_tokens), MALFORMED, "TOKEN_NOT_IN_UNIVERSE"))
    if policy.allowed_exchanges:
        checks.append((~F.upper(F.trim("exchange")).isin(*policy.allowed_exchanges), MALFORMED, "INVALID_EXCHANGE"))
    checks += [
        (-lag > policy.max_future_skew_seconds, MALFORMED, "FUTURE_TIMESTAMP_EXCEEDED"), (lag > policy.max_stale_seconds, STALE, "STALE_TICK_LATENCY")]
    df = ticks
    if policy.check_session and calendar is not None:
        hours = calendar.select(c("session_date").alias("_day"), c("open_at").alias("_open"), c("close_at").alias("_close"))
        df = ticks.withColumn("_local", session_date("exchange_timestamp")).join(hours, c("_local") == c("_day"), "left")
        checks += [
            (F.weekday("_local") >= 5, CLOSED, "WEEKEND_SESSION_REJECTED"), (c("_open").isNull(), CLOSED, "HOLIDAY_SESSION_REJECTED"),
            (~at.between(c("_open"), c("_close")), CLOSED, "OUT_OF_SESSION_HOURS")]
    price, booked = c("ltp"), {"bids", "asks"} <= {*ticks.columns}
    depth = price.isNull() & c("bids").isNotNull() & c("asks").isNotNull() if booked else F.lit(False)
    checks += [
        (~depth & (price.isNull() | F.isnan(price) | (F.abs(price) == float("inf"))), MALFORMED, "PRICE_NON_FINITE"), (price <= 0, MALFORMED, "PRICE_NON_POSITIVE"),
        (~depth & (c("cumulative_volume") < 0), MALFORMED, "VOLUME_NEGATIVE")]
    if booked:
        fault = book_fault()
        checks += [(fault == code, action, code) for code, action in BOOK_FAULTS.items()]
    action, reason = F.lit(ACCEPT), F.lit("VALID_TICK")
    for test, act, why in reversed(checks):
        action, reason = F.when(test, act).otherwise(action), F.when(test, why).otherwise(reason)
    return df.withColumns({"action": action, "reason": reason, "latency_ms": lag * 1000}).drop("_local", "_day", "_open", "_close")


def fingerprint() -> Column:
    at = F.date_format("exchange_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat_ws(":", "token", F.col("sequence_number").cast("string"), at, F.format_string("%.4f", "ltp"), F.col("cumulative_volume").cast("string"))


def dedup(ticks: DataFrame, lateness: str = "2 seconds") -> DataFrame:
    """Drop repeated ticks; on a stream the memory is bounded by the watermark."""
    marked = ticks.withColumn("fingerprint", fingerprint())
    if marked.isStreaming:
        return marked.withWatermark("exchange_timestamp", lateness).dropDuplicatesWithinWatermark(["fingerprint"])
    return marked.dropDuplicates(["fingerprint"])


STATE_COLUMNS = ("token", "event_id", "exchange_timestamp", "sequence_number", "ltp", "cumulative_volume")
VERDICT = "token string, event_id bigint, exchange_timestamp timestamp, sequence_number bigint, ltp double, cumulative_volume bigint, action string, reasons string"


class _Gate:
    """Verdicts for the ticks of one token in arrival order; the state is that of the last accepted tick."""

    def __init__(self, policy: AdmissionPolicy, session: int = 0, sequence: int = 0, at_us: int = 0, price: float = 0.0, volume: int = 0):
        self.policy = policy
        self.session, self.sequence, self.at_us, self.price, self.volume = session, sequence, at_us, price, volume

    def verdict(self, session: int, sequence: int, at_us: int, price: float, volume: int, seen: bool) -> tuple[str, list[str]]:
        if seen:
            return DUPLICATE, ["DUPLICATE_TICK_FINGERPRINT"]
        reasons, same = [], session == self.session
        if same and sequence > 0 and self.sequence > 0:
            if sequence == self.sequence:
                return DUPLICATE, ["DUPLICATE_SEQUENCE_NUMBER"]
            if sequence != self.sequence + 1:
                reasons.append("SEQUENCE_GAP_DETECTED")
        if same and self.at_us - at_us > self.policy.out_of_order_ms * 1000:
            return STALE, [*reasons, "OUT_OF_ORDER_TIMESTAMP"]
        if same and 0 < volume < self.volume:
            return QUARANTINE, [*reasons, "CUMULATIVE_VOLUME_DECREASE"]
        if same and self.price > 0 and abs(price - self.price) / self.price > self.policy.max_price_velocity:
            return QUARANTINE, [*reasons, "EXTREME_PRICE_VELOCITY"]
        self.sequence = max(self.sequence, sequence)
        self.session, self.at_us, self.price, self.volume = session, at_us, price, volume
        return ACCEPT, [*reasons, "VALID_TICK"]


def _facts(pdf: pd.DataFrame) -> tuple:
    """(local session, sequence, microseconds, price, volume) arrays of a batch."""
    at = pd.to_datetime(pdf["exchange_timestamp"])
    at = at.dt.tz_localize("UTC") if at.dt.tz is None else at.dt.tz_convert("UTC")
    us = at.astype("datetime64[us, UTC]").astype("int64").to_numpy()
    local = at.dt.tz_convert(LOCAL_TZ)
    session = (local.dt.year * 10_000 + local.dt.month * 100 + local.dt.day).to_numpy()
    sequence = pdf["sequence_number"].fillna(0).astype("int64").to_numpy()
    return session, sequence, us, pdf["ltp"].to_numpy(dtype=float), pdf["cumulative_volume"].fillna(0).astype("int64").to_numpy()


def _walk(facts: tuple, lo: int, hi: int, gate: _Gate, seen) -> Iterator[tuple[str, str]]:
    session, sequence, us, price, volume = facts
    for i in range(lo, hi):
        key = f"{sequence[i]}:{us[i]}:{price[i]:.4f}:{volume[i]}"
        day = int(session[i])
        action, why = gate.verdict(day, int(sequence[i]), int(us[i]), float(price[i]), int(volume[i]), seen.known(key, day, int(us[i])))
        if action == ACCEPT:
            seen.add(key, day, int(us[i]))
        yield action, ",".join(why)


class _Memory:
    def __init__(self):
        self.keys: dict[str, int] = {}

    def known(self, key: str, session: int, at_us: int) -> bool:
        return key in self.keys

    def add(self, key: str, session: int, at_us: int) -> None:
        self.keys[key] = session

    def forget(self, session: int) -> None:
        """Keep the fingerprints of a session only."""
        if any(s != session for s in self.keys.values()):
            self.keys = {k: s for k, s in self.keys.items() if s == session}


def admit_batch(ticks: DataFrame, policy: AdmissionPolicy = AdmissionPolicy(), arrival: Sequence[str] = ("received_at", "event_id")) -> DataFrame:
    """The state rules over stored ticks, as the stream applies them in order of arrival.

    The highest sequence number carries over from one local session to the next, so the ticks of
    a token are read by one task, batch by batch in Spark's order; it remembers the fingerprints
    of the sessions that ticks still arrive for.
    """
    order = list(arrival)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate, seen = None, _Gate(policy), _Memory()
        for pdf in batches:
            keys = pdf["token"].astype(str)
            starts = [0, *(i for i in range(1, len(keys)) if keys.iat[i] != keys.iat[i - 1]), len(keys)]
            facts = _facts(pdf)
            verdicts: list[tuple[str, str]] = []
            for lo, hi in zip(starts, starts[1:]):
                if keys.iat[lo] != current:
                    current, gate, seen = keys.iat[lo], _Gate(policy), _Memory()
                verdicts.extend(_walk(facts, lo, hi, gate, seen))
                seen.forget(gate.session)
            out = pdf[list(STATE_COLUMNS)].copy()
            out["action"], out["reasons"] = [v[0] for v in verdicts], [v[1] for v in verdicts]
            yield out

    needed = ticks.select(*dict.fromkeys([*STATE_COLUMNS, *order]))
    return needed.repartition("token").sortWithinPartitions("token", *order).mapInPandas(run, VERDICT)


HOUR_US, OTHER = 3_600_000_000, -(2**62)


class _Prints:
    """A token's fingerprints in the state: those of its session by the hour, those of other sessions under OTHER.

    A tick later than all accepted ones has not been seen, so ticks in order read nothing; a late one reads its hour.
    """

    def __init__(self, stored, token: str | None, session: int, newest: int, hours: list[int]):
        self.stored, self.token, self.session, self.newest, self.hours = stored, token, session, newest, set(hours)
        self.parts: dict[int, dict[str, int]] = {}
        self.fresh: dict[str, int] = {}

    def part(self, hour: int) -> dict[str, int]:
        if hour not in self.parts:
            self.parts[hour] = dict(zip(*self.stored.getValue((self.token, hour)))) if hour in self.hours else {}
        return self.parts[hour]

    def known(self, key: str, session: int, at_us: int) -> bool:
        return at_us <= self.newest and (key in self.fresh or key in self.part(at_us // HOUR_US if session == self.session else OTHER))

    def add(self, key: str, session: int, at_us: int) -> None:
        self.fresh[key], self.newest = session, max(self.newest, at_us)

    def close(self, session: int) -> list[int]:
        """Store the fingerprints of the micro-batch; a session that another follows is forgotten."""
        keep = self.fresh
        if self.session and session != self.session:
            keep = {k: s for k, s in (self.part(OTHER) | self.fresh).items() if s == session}
            for hour in self.hours:
                self.stored.removeKey((self.token, hour))
            self.hours, self.parts = set(), {}
        added: dict[int, dict[str, int]] = {}
        for key, day in keep.items():
            added.setdefault(int(key.split(":")[1]) // HOUR_US if day == session else OTHER, {})[key] = day
        for hour, keys in added.items():
            whole = self.part(hour) | keys
            self.stored.updateValue((self.token, hour), (list(whole), list(whole.values())))
        return sorted(self.hours | {*added})


class _TickState(StatefulProcessor):
    """The same rules on a stream: last accepted tick and this session's fingerprints of each token of a group."""

    FIELDS = ("session", "sequence", "at_us", "price", "volume", "newest", "hours")

    def __init__(self, policy: AdmissionPolicy = AdmissionPolicy()) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        types = ["array<double>" if f == "price" else "array<array<bigint>>" if f == "hours" else "array<bigint>" for f in self.FIELDS]
        self.last = handle.getValueState("last", ", ".join(["token array<string>", *(f"{f} {t}" for f, t in zip(self.FIELDS, types))]))
        self.prints = handle.getMapState("prints", "token string, hour bigint", "key array<string>, session array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["token", "received_at", "event_id"], ignore_index=True)
        last = {token: state for token, *state in zip(*self.last.get())} if self.last.exists() else {}
        facts, code = _facts(pdf), pd.factorize(pdf["token"], use_na_sentinel=False)[0]
        starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(pdf)]
        verdicts: list[tuple[str, str]] = []
        for lo, hi in zip(starts, starts[1:]):
            token = pdf["token"].iat[lo]
            *state, newest, hours = last.get(token, (0, 0, 0, 0.0, 0, -(2**63), []))
            gate, seen = _Gate(self.policy, *state), _Prints(self.prints, token, state[0], newest, hours)
            verdicts.extend(_walk(facts, lo, hi, gate, seen))
            hours = seen.close(gate.session)
            last[token] = (gate.session, gate.sequence, gate.at_us, gate.price, gate.volume, seen.newest, hours)
        self.last.update((list(last), *(list(column) for column in zip(*last.values()))))
        yield pdf[list(STATE_COLUMNS)].assign(action=[v[0] for v in verdicts], reasons=[v[1] for v in verdicts])

    def close(self) -> None:
        pass


def admit_stateful(ticks: DataFrame, policy: AdmissionPolicy = AdmissionPolicy()) -> DataFrame:
    """Streaming admission by token, tokens dealt to groups; needs the RocksDB state store provider."""
    needed = ticks.select(shard("token"), *STATE_COLUMNS, "received_at")
    return needed.groupBy("shard").transformWithStateInPandas(_TickState(policy), VERDICT, "append", "none")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quarantined(judged: DataFrame) -> DataFrame:
    """Rows to set aside, with their payload."""
    held = judged.filter(F.col("action") != ACCEPT)
    return held.withColumn("raw_payload_json", F.to_json(F.struct(*[F.col(c) for c in held.columns])))


def admission_stats(judged: DataFrame) -> DataFrame:
    """One row: totals, rates and the 90th percentile of the clock offset (bounded-memory sketch)."""
    n = lambda a: F.sum((F.col("action") == a).cast("long"))
    out = judged.agg(
        F.count(F.lit(1)).alias("total_evaluated"), n(ACCEPT).alias("accepted"), n(DUPLICATE).alias("dropped_duplicate"), n(STALE).alias("dropped_stale"),
        n(CLOSED).alias("dropped_out_of_session"), n(QUARANTINE).alias("quarantined"), n(MALFORMED).alias("rejected_malformed"),
        F.percentile_approx(-F.col("latency_ms"), F.lit(0.9), F.lit(10_000)).alias("clock_offset_p90_ms"))
    total = F.greatest("total_evaluated", F.lit(1))
    return out.withColumns({"acceptance_rate_pct": F.col("accepted") / total * 100, "quarantine_rate_pct": F.col("quarantined") / total * 100})


