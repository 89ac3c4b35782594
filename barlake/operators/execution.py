"""Costs, orders, ledgers, positions and risk decisions as table operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.packs import PACK_ROWS, UPTO, Rows, over_packs, pack
from barlake.functions.windows import BLOCK_ROWS, CHUNK, Running, add_smoothing, asof, chunk_starts, growth, in_chunks, scan, series, smoothing_lookback
from barlake.operators.features import session_date
from barlake.session import broadcast_if_small, discard, sliced, staged, staged_parts


@dataclass(frozen=True)
class CostSchedule:
    """Delivery rates; a dated list of them is configuration, not data."""

    version: str = "delivery-2026-04"
    effective_from: date = date(2026, 4, 1)
    brokerage_rate_bps: float = 10.0
    brokerage_min: float = 5.0
    brokerage_max: float = 20.0
    stt_buy_bps: float = 10.0
    stt_sell_bps: float = 10.0
    exchange_transaction_bps: float = 0.30699
    sebi_bps: float = 0.01
    ipft_bps: float = 0.00001
    dp_charge_sell: float = 20.0
    gst_rate: float = 0.18
    stamp_duty_buy_bps: float = 1.5
    spread_bps: float = 2.0
    slippage_bps: float = 3.0
    impact_bps_at_full_participation: float = 10.0
    max_volume_participation: float = 0.05
    max_allowed_drag_bps: float = 500.0
    minimum_daily_traded_value: float = 1_000_000.0


DEFAULT_SCHEDULES = (
    CostSchedule("delivery-2010-01", date(2010, 1, 1), stt_buy_bps=12.5, stt_sell_bps=12.5, exchange_transaction_bps=0.325),
    CostSchedule("delivery-2016-06", date(2016, 6, 1), exchange_transaction_bps=0.325),
    CostSchedule("delivery-2024-10", date(2024, 10, 1), exchange_transaction_bps=0.297),
    CostSchedule(),
)


def dated(schedules: Sequence[CostSchedule], starts: Sequence[date]) -> list[CostSchedule]:
    """The same rates with other validity dates."""
    return [replace(s, effective_from=d) for s, d in zip(schedules, starts)]


def cost_schedule_asof(fills: DataFrame, schedules: Sequence[CostSchedule] = DEFAULT_SCHEDULES, ts: str = "timestamp") -> DataFrame:
    """Attach ``schedule``: the latest one in force on the local date, else the first.

    The schedule list is part of the plan as a row expression, so no join is needed.
    """
    ordered = sorted(schedules, key=lambda s: s.effective_from)
    as_struct = lambda s: F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()])
    day = session_date(ts)
    chosen = as_struct(ordered[0])
    for s in ordered[1:]:
        chosen = F.when(day >= F.lit(s.effective_from), as_struct(s)).otherwise(chosen)
    return fills.withColumn("schedule", chosen)


def _s(name: str) -> Column:
    return F.col(f"schedule.{name}")


def impact_bps(participation: Column) -> Column:
    limit = _s("max_volume_participation")
    used = F.least(F.greatest(participation, F.lit(0.0)), limit)
    return _s("impact_bps_at_full_participation") * used / F.greatest(limit, F.lit(1e-12))


COMPONENTS = (
    "brokerage", "stt", "exchange_transaction", "sebi", "ipft", "dp_charge", "gst", "stamp_duty", "spread", "slippage", "market_impact",
)


def cost_breakdown(fills: DataFrame, notional: Column, side: Column, participation: Column) -> DataFrame:
    """Statutory, broker and execution components of each fill; needs ``schedule``."""
    amount = F.abs(notional.cast("double"))
    any_, buy = amount > 0, side == "BUY"
    bps = lambda rate: amount * rate / 10_000
    clamp = F.least(_s("brokerage_max"), F.greatest(_s("brokerage_min"), bps(_s("brokerage_rate_bps"))))
    df = fills.withColumns({
        "brokerage": F.when(any_, clamp).otherwise(0.0),
        "stt": bps(F.when(buy, _s("stt_buy_bps")).otherwise(_s("stt_sell_bps"))),
        "exchange_transaction": bps(_s("exchange_transaction_bps")),
        "sebi": bps(_s("sebi_bps")), "ipft": bps(_s("ipft_bps")),
        "dp_charge": F.when(~buy & any_, _s("dp_charge_sell")).otherwise(0.0),
        "stamp_duty": F.when(buy, bps(_s("stamp_duty_buy_bps"))).otherwise(0.0),
        "spread": bps(_s("spread_bps")), "slippage": bps(_s("slippage_bps")), "market_impact": bps(impact_bps(participation)),
    })
    taxed = F.col("brokerage") + F.col("exchange_transaction") + F.col("sebi") + F.col("ipft") + F.col("dp_charge")
    df = df.withColumn("gst", _s("gst_rate") * taxed)
    add = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return df.withColumns({"statutory_fees": add(COMPONENTS[:8]), "execution_drag": add(COMPONENTS[8:]), "total_cost": add(COMPONENTS)})


def execution_price(orders: DataFrame, price: Column, side: Column, participation: Column) -> DataFrame:
    """Price moved by spread, slippage and impact, or a reject code; needs ``schedule``."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bps = _s("spread_bps") + _s("slippage_bps") + impact_bps(participation)
    moved = price * F.when(side == "BUY", 1 + bps / 10_000).otherwise(1 - bps / 10_000)
    code = (
        F.when(bad(price) | (price <= 0), "INVALID_PRICE").when(bad(participation) | (participation < 0), "MAX_PARTICIPATION_EXCEEDED")
        .when(bps > _s("max_allowed_drag_bps"), "MAX_EXECUTION_DRAG_EXCEEDED").when(bad(moved) | (moved <= 0), "INVALID_PRICE")
    )
    return orders.withColumns({"reject_code": code, "execution_price": F.when(code.isNull(), moved)})


# --- from signals to orders and returns ---------------------------------------------------------

def next_bar_orders(signals: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A target change at t becomes an order at the next bar's open, sized on what was known at t."""
    s = series(signals, keys, ("timestamp",), lookback=1, lookahead=1)
    before = F.coalesce(F.lag("target_position").over(s.w), F.lit(0.0))
    s = s.with_columns({
        "delta_position": F.coalesce("target_position", F.lit(0.0)) - before,
        "execution_timestamp": F.lead("timestamp").over(s.w), "base_price": F.lead("open").over(s.w)})
    changed = s.done().filter((F.col("delta_position") != 0) & F.col("execution_timestamp").isNotNull())
    return changed.select(
        *keys, F.col("timestamp").alias("signal_timestamp"), "execution_timestamp", "base_price", "delta_position",
        F.when(F.col("delta_position") > 0, "BUY").otherwise("SELL").alias("side"),
        F.col("close").alias("known_close"), F.col("volume").alias("known_volume"))


def signal_deltas(
    signals: DataFrame, capital: float = 100_000.0, fee_bps: float = 0.0, cost_bps: float = 0.0, fraction: float = 1.0, at_close: bool = False,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Orders implied by target changes with their quantity, price and fee.

    With partial fills the held position follows the target as a linear filter, so the
    recursion is a smoothing window rather than a row loop.
    """
    lookback = 1 if fraction >= 1 else smoothing_lookback(fraction) + 1
    base = signals.withColumn("_want", F.coalesce("target_position", F.lit(0.0)))
    s = series(base, keys, ("timestamp",), lookback=lookback, lookahead=1)
    if fraction >= 1:
        held = F.lag("_want").over(s.w)
    else:
        s = add_smoothing(s, "_want", fraction, "_held", seeded=False)
        held = F.lag("_held").over(s.w)
    s = s.with_columns({
        "delta_position": F.col("_want") - F.coalesce(held, F.lit(0.0)),
        "_next_open": F.lead("open").over(s.w), "_next_ts": F.lead("timestamp").over(s.w)})
    df = s.done().filter(F.abs("delta_position") > DUST)  # a filter never quite reaches its target
    source = F.col("close") if at_close else F.coalesce("_next_open", "close")
    sign = F.signum("delta_position")
    df = df.withColumns({
        "side": F.when(F.col("delta_position") > 0, "BUY").otherwise("SELL"), "requested_at": F.col("timestamp"),
        "filled_at": F.col("timestamp") if at_close else F.coalesce("_next_ts", "timestamp"),
        "price": source * (1 + sign * cost_bps / 10_000),
    })
    wanted = F.abs("delta_position") * capital / F.greatest("price", F.lit(1e-9))
    df = df.withColumns({"requested_quantity": wanted, "quantity": wanted * min(max(fraction, 0.0), 1.0)})
    return df.withColumns({
        "fees": F.col("quantity") * F.col("price") * fee_bps / 10_000,
        "status": F.lit("FILLED" if fraction >= 1 else "PARTIALLY_FILLED"),
    }).drop("_want", "_held", "_next_open", "_next_ts")


def screen_capacity(orders: DataFrame) -> DataFrame:
    """Reject or cap an order by the liquidity known before it; needs ``schedule`` and lagged columns."""
    adv, value = F.col("lagged_adv"), F.col("lagged_traded_value")
    unknown = adv.isNull() | (adv <= 0) | value.isNull() | (value <= 0)
    cap = F.floor(adv * _s("max_volume_participation")).cast("double")
    filled = F.least(F.col("requested_quantity"), cap)
    reason = (
        F.when(unknown, "INSUFFICIENT_HISTORY_FOR_CAPACITY").when(value < _s("minimum_daily_traded_value"), "LIQUIDITY_REJECTION")
        .when(filled <= 0, "VOLUME_CAP_REJECTION")
    )
    quantity = F.when(reason.isNull(), filled).otherwise(0.0)
    status = F.when(reason.isNotNull(), "REJECTED").when(filled < F.col("requested_quantity"), "PARTIALLY_FILLED").otherwise("FILLED")
    return orders.withColumns({"rejection_reason": reason, "filled_quantity": quantity, "status": status})


def vector_backtest(signals: DataFrame, capital: float = 100_000.0, cost_bps: float = 0.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Yesterday's position times today's return, less turnover cost; equity and drawdown."""
    s = series(signals, keys, ("timestamp",), lookback=1)
    position = F.coalesce("target_position", F.lit(0.0))
    s = s.with_columns({"position": position})
    before = F.coalesce(F.lag("position").over(s.w), F.lit(0.0))
    prior = F.lag("close").over(s.w)
    s = s.with_columns({"bar_return": F.coalesce(F.col("close") / F.nullif(prior, F.lit(0.0)) - 1, F.lit(0.0)), "_before": before})
    s = s.with_columns({
        "gross_return": F.col("_before") * F.col("bar_return"), "turnover": F.abs(F.col("position") - F.col("_before"))})
    s = s.with_columns({"net_return": F.col("gross_return") - F.col("turnover") * cost_bps / 10_000})
    return growth(s.done().drop("_before"), keys, ("timestamp",), "net_return", capital)


# What running sums of fractional quantities leave of a holding that was sold, relative to its size.
DUST = 1e-9


# --- ledgers ------------------------------------------------------------------------------------

class _Book:
    """Average-cost bookkeeping of one chunk; the holding before it is known from the sums of the chunks before."""

    POOLS = ("average", "cost_pool", "drag_pool")

    def __init__(self, rows: Rows, before: dict, fees_in_average: bool, drag_bps: float):
        take = lambda c: rows[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.buy = _buys(rows)
        self.quantity, self.price = take("quantity"), take("price")
        fees = rows["fees"].fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False) if "fees" in rows else 0.0
        if fees_in_average:
            self.drag, self.cost = np.zeros(len(self.buy)), fees
        else:
            self.drag = take("execution_drag") if "execution_drag" in rows else np.abs(self.quantity * self.price) * drag_bps / 10_000
            self.cost = take("total_cost") if "total_cost" in rows else fees + self.drag
        self.held = self._held_before(_moves(rows), before["_s0"] or 0.0, before["_m0"] or 0.0)
        self.opens = self.buy & (self.held <= 0)
        self.closed = np.where(self.buy, 0.0, np.minimum(self.quantity, self.held))
        self.empty = ~self.buy & (self.held - self.closed <= DUST * np.maximum(self.held, 1.0))
        self.extra = self.cost if fees_in_average else np.zeros(len(self.buy))

    def _held_before(self, moves: np.ndarray, opened: float, lowest: float) -> np.ndarray:
        """The running sum minus its running minimum, over all chunks; a holding of dust is none."""
        total = np.cumsum(moves)
        low = np.concatenate([[np.inf], np.minimum.accumulate(total)[:-1]])
        held = opened + total - moves - np.minimum(lowest, opened + low)
        return np.where(held > DUST * np.fmax(self.quantity, 1.0), held, 0.0)

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pool after a fill is keep * before + gain; returns (keep, gain) per fill and pool."""
        total = np.maximum(self.held + self.quantity, 1e-12)
        kept = np.where(self.buy, self.held / total, 1.0)
        gained = np.where(self.buy, (self.quantity * self.price + self.extra) / total, 0.0)
        left = np.where(self.buy, 1.0, 1 - self.closed / np.maximum(self.held, 1e-12))
        keep = np.stack([kept, left, left], axis=1)
        gain = np.stack([gained, np.where(self.buy, self.cost, 0.0), np.where(self.buy, self.drag, 0.0)], axis=1)
        keep[self.empty], gain[self.empty] = 0.0, 0.0
        return keep, gain


def _buys(rows: Rows) -> np.ndarray:
    return pc.equal(rows["side"], "BUY").fill_null(False).to_numpy(zero_copy_only=False)


def _moves(rows: Rows) -> np.ndarray:
    quantity = rows["quantity"].fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(_buys(rows), quantity, -quantity)


def _moved(rows: Rows) -> dict:
    total = np.cumsum(_moves(rows))
    return {"_sum": float(total[-1]), "_min": float(total.min())}


def chained(keep: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i of the result maps a starting value x to keep * x + gain after steps 0 to i, by doubling."""
    keep, gain, reach = keep.copy(), gain.copy(), 1
    while reach < len(keep):
        gain[reach:] = keep[reach:] * gain[:-reach] + gain[reach:]
        keep[reach:] = keep[reach:] * keep[:-reach]
        reach *= 2
    return keep, gain


def _latest(marks: np.ndarray) -> np.ndarray:
    """Per row the last marked row at or before it, -1 for none."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


def _ledger(
    fills: DataFrame, keys: Sequence[str], fees_in_average: bool, drag_bps: float, block_rows: int | None,
    ties: Sequence[str], values: Mapping[str, Column], within: Sequence[str], parts: int,
) -> DataFrame:
    """Fills with their bookkeeping.

    The rows of a key are cut into chunks of bounded rows by counts per time, shuffled once to be stored as arrays in
    order, and read from there twice: to sum up what each chunk does to the pools, and to write its fills with the pools
    of the chunks before.  Only sums of chunks are windowed or chained.
    """
    keys, ts = list(keys), "timestamp"
    order = [ts, *ties] if ties else [ts, "fill_no" if "fill_no" in fills.columns else "fill_id"]
    keep = [ts, *values] if values else [c for c in fills.columns if c not in keys]
    times = staged_parts([fills.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))])
    found = chunk_starts(times, keys, ts, block_rows or min(BLOCK_ROWS, PACK_ROWS))
    starts = None
    if ties:
        rest = [k for k in keys if k not in within]
        upto = scan(times, list(within), (ts, *rest), [Running(UPTO, "sum", F.col("_n"), inclusive=False)], seconds=60 * 86_400)
        upto = upto.select(*keys, ts, F.coalesce(UPTO, F.lit(0)).alias(UPTO))
        starts = staged_parts([in_chunks(upto, found, keys, ts)])

    def packed(i: int) -> DataFrame:
        rows = in_chunks(sliced(fills, keys, (i, parts)), found, keys, ts)
        if values:
            rows = rows.repartition(*keys, CHUNK).withColumns(dict(values))
        rows = rows.select(*dict.fromkeys([*keys, CHUNK, *order, *keep]))
        return pack(rows, keys, order, keep, _moved, "_sum double, _min double", None if starts is None else sliced(starts, keys, (i, parts)))

    packs = staged_parts(packed(i) for i in range(parts))
    for stage in (times, *([] if starts is None else [starts]), found[0]):
        discard(stage)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = packs.select(*keys, CHUNK, "_sum", "_min").withColumns({
        "_s0": F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)), "_end": F.max(CHUNK).over(Window.partitionBy(*keys))})
    opened = staged(sums.withColumn("_m0", F.least(F.lit(0.0), F.min(F.col("_s0") + F.col("_min")).over(earlier))).drop("_sum", "_min"))
    lists = [f.name for f in packs.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name not in keys]
    listed = packs.select(*keys, CHUNK, *lists)
    marks = "entry_us bigint, entry_reason string"

    def reason_of(rows: Rows) -> pa.Array:
        if "reason" in rows and not fees_in_average:
            return rows["reason"].fill_null("ENTRY")
        return pa.array(np.full(len(rows[ts]), "ENTRY"), pa.string())

    def summarise(head: dict, rows: Rows) -> dict:
        book = _Book(rows, head, fees_in_average, drag_bps)
        keep, gain = (x[-1] for x in chained(*book.terms()))
        last = _latest(book.opens | book.empty)[-1]
        entered = last >= 0 and not book.empty[last]
        return {
            **{f"keep_{n}": keep[i] for i, n in enumerate(_Book.POOLS)}, **{f"gain_{n}": gain[i] for i, n in enumerate(_Book.POOLS)},
            "changed": bool(last >= 0), "entry_us": rows[ts][last].cast(pa.int64()).as_py() if entered else None,
            "entry_reason": reason_of(rows)[last].as_py() if entered else None}

    def chain(summaries: pd.DataFrame) -> pd.DataFrame:
        state, out = {**{n: 0.0 for n in _Book.POOLS}, "entry_us": None, "entry_reason": None}, []
        for row in summaries.sort_values(CHUNK).to_dict(orient="records"):
            pools = {n: row[f"keep_{n}"] * state[n] + row[f"gain_{n}"] for n in _Book.POOLS}
            us, reason = (row if row["changed"] else state)["entry_us"], (row if row["changed"] else state)["entry_reason"]
            state = {**pools, "entry_us": None if us is None or pd.isna(us) else int(us), "entry_reason": reason}
            out.append({**{k: row[k] for k in keys}, CHUNK: row[CHUNK] + 1, **state})
        return pd.DataFrame(out)

    def emit(head: dict, rows: Rows) -> dict:
        book = _Book(rows, head, fees_in_average, drag_bps)
        keep, gain = book.terms()
        run_keep, run_gain = chained(keep, gain)
        start = np.array([[head[p] or 0.0 for p in _Book.POOLS]])
        before = np.concatenate([start, run_keep[:-1] * start + run_gain[:-1]])
        after = np.where(book.buy, keep[:, 0] * before[:, 0] + gain[:, 0], before[:, 0])
        share = book.closed / np.maximum(book.held, 1e-12)
        opening, emptied = _latest(book.opens), np.concatenate([[-1], _latest(book.empty)[:-1]])
        own, inherited = opening > emptied, (opening < 0) & (emptied < 0) & (head["entry_us"] is not None)
        at = pa.array(np.maximum(opening, 0), mask=~own)
        known = pa.array(inherited)
        return {
            **rows, "closed_quantity": pa.array(book.closed), "average_cost": pa.array(after),
            "entry_cost": pa.array(before[:, 1] * share), "entry_drag": pa.array(before[:, 2] * share),
            "entry_us": pc.if_else(known, pa.scalar(head["entry_us"], pa.int64()), rows[ts].cast(pa.int64()).take(at)),
            "entry_reason": pc.if_else(known, pa.scalar(head["entry_reason"], pa.string()), reason_of(rows).take(at))}

    key_fields = [packs.schema[k] for k in [*keys, CHUNK]]
    fields = lambda text: list(T._parse_datatype_string(text).fields)
    pools = ", ".join(f"{p}_{n} double" for p in ("keep", "gain") for n in _Book.POOLS)
    early = listed.join(broadcast_if_small(opened, opened), [*keys, CHUNK]).filter(F.col(CHUNK) < F.col("_end")).drop("_end")
    summaries = over_packs(early, summarise, lists, T.StructType([*key_fields, *fields(f"{pools}, changed boolean, {marks}")]))
    states = summaries.groupBy(*keys).applyInPandas(
        chain, T.StructType([*key_fields, *fields(f"average double, cost_pool double, drag_pool double, {marks}")]))
    heads = staged(opened.drop("_end").join(states, [*keys, CHUNK], "left"))
    discard(opened)
    made = fields(f"closed_quantity double, average_cost double, entry_cost double, entry_drag double, {marks}")
    names = {f.name for f in made}
    heads = heads.withColumnsRenamed({"entry_reason": "_reason", "entry_us": "_us"})
    placed = listed.join(broadcast_if_small(heads, heads), [*keys, CHUNK], "left")
    kinds = {**{k: packs.schema[k].dataType for k in keys}, **{c: packs.schema[c].dataType.elementType for c in lists}}
    shown = [c for c in (fills.columns if not values else [*keys, *lists]) if c not in names]
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in shown], *made])
    renamed = lambda head, rows: emit({**head, "entry_us": head["_us"], "entry_reason": head["_reason"]}, rows)
    return over_packs(placed, renamed, lists, schema)


def ledger(
    fills: DataFrame, keys: Sequence[str] = ("run_id", "symbol"), drag_bps: float = 0.0, block_rows: int | None = None,
    ties: Sequence[str] = (), values: Mapping[str, Column] | None = None, within: Sequence[str] = ("run_id",), parts: int = 1,
) -> DataFrame:
    """Attribution of every fill: holding, average cost, pooled entry costs, realized P&L, holding days, exit class.

    Fills without ``total_cost`` are charged fees plus ``drag_bps`` of their value.

    ``fills`` are read before this returns, and what is needed of them is stored.  Those without ``fill_no`` or ``fill_id``
    come with ``ties``, the columns that order fills of one key and time; they get ``fill_no``, their number in ``within`` by
    time, the other keys and ``ties``.  ``values`` are the columns of a fill where they follow from others: they are computed
    behind the shuffle, and what they follow from is not returned.  Fills are shuffled in ``parts`` slices of their keys, one
    after the other, each of which reads all of them.
    """
    df = _ledger(fills, keys, False, drag_bps, block_rows, ties, values or {}, within, parts)
    drag = F.col("execution_drag") if "execution_drag" in df.columns else F.abs(F.col("quantity") * F.col("price")) * drag_bps / 10_000
    cost = F.col("total_cost") if "total_cost" in df.columns else F.coalesce("fees", F.lit(0.0)) + drag
    sell = F.col("side") == "SELL"
    gross = F.when(sell, (F.col("price") - F.col("average_cost")) * F.col("closed_quantity") + F.col("entry_drag") + drag).otherwise(0.0)
    leaving = F.when(F.col("target_weight") <= 0, "RANK_REMOVAL").otherwise("REBALANCE_REDUCTION") if "target_weight" in df.columns else F.lit("SIGNAL_FLIP")
    entered = F.timestamp_micros("entry_us")
    df = df.withColumns({
        "gross_pnl": gross, "cost": cost, "realized_pnl": gross - cost, "entry_timestamp": entered,
        "holding_period_days": F.when(sell, (F.unix_micros("timestamp") - F.col("entry_us")) / F.lit(86_400e6)),
        "exit_classification": F.when(sell, leaving).otherwise("ENTRY"),
    })
    return df.drop("entry_us")


def ledger_round_trips(booked: DataFrame) -> DataFrame:
    """One row per closing fill of a known entry."""
    return booked.filter("side = 'SELL' AND entry_timestamp IS NOT NULL").select(
        F.col("fill_id").alias("trade_id"), "run_id", "symbol", "entry_timestamp", F.col("timestamp").alias("exit_timestamp"),
        F.col("closed_quantity").alias("quantity"), F.col("average_cost").alias("entry_price"), F.col("price").alias("exit_price"),
        "entry_cost", F.col("cost").alias("exit_cost"), "gross_pnl", (F.col("gross_pnl") - F.col("entry_cost") - F.col("cost")).alias("net_pnl"),
        "holding_period_days", "entry_reason", "exit_classification")


def trade_pnls(
    fills: DataFrame, keys: Sequence[str] = ("run_id", "symbol"), block_rows: int | None = None,
    ties: Sequence[str] = (), values: Mapping[str, Column] | None = None, within: Sequence[str] = ("run_id",), parts: int = 1,
) -> DataFrame:
    """P&L of each sale against an average cost that includes entry fees; sales are capped at the holding.

    The last parameters are those of ``ledger``.
    """
    df = _ledger(fills, keys, True, 0.0, block_rows, ties, values or {}, within, parts)
    pnl = (F.col("price") - F.col("average_cost")) * F.col("closed_quantity") - F.coalesce("fees", F.lit(0.0))
    closed = df.filter("side = 'SELL' AND closed_quantity > 0").withColumn("pnl", pnl)
    return closed.select(*keys, "timestamp", *[c for c in ("fill_id", "fill_no") if c in df.columns], "closed_quantity", "pnl")


# --- positions ----------------------------------------------------------------------------------

def frozen_prices(bars: DataFrame) -> DataFrame:
    """Last known close of every symbol on every panel date from its first bar on."""
    dates = bars.select(session_date().alias("date")).distinct()
    end = bars.agg(F.max(session_date())).scalar()
    first = bars.groupBy("symbol").agg(F.min(session_date()).alias("_first")).withColumn("_end", end)
    grid = first.select("symbol", F.explode(F.sequence("_first", "_end")).alias("date")).join(dates, "date", "left_semi")
    closes = bars.groupBy("symbol", session_date().alias("date")).agg(F.max_by("close", "timestamp").alias("_close"))
    filled = scan(grid.join(closes, ["symbol", "date"], "left").withColumn("_t", F.col("date").cast("timestamp")), "symbol", ("_t",), [Running("price", "last", F.col("_close"))])
    return filled.select("symbol", "date", "price")


def holdings(fills: DataFrame) -> DataFrame:
    """(run_id, symbol, from, until, quantity): stretches of days with one open holding at the close; ``until`` is the day of
    the next change, null for the last.

    Fills are summed per day first, so the window of a run and symbol holds its trading days, not its fills.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    moves = fills.groupBy("run_id", "symbol", session_date().alias("from")).agg(F.sum(signed).alias("_q"))
    days = Window.partitionBy("run_id", "symbol").orderBy("from")
    spans = moves.select("run_id", "symbol", "from", F.lead("from").over(days).alias("until"), F.sum("_q").over(days).alias("quantity"))
    return spans.filter("quantity <> 0")


def positions_at_close(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """Signed quantity and value per run, symbol and panel date; a missing bar keeps the last price.

    Holdings are stretched over their days and meet prices on (symbol, date), so a closed position makes no row and a
    popular symbol is as many keys as dates.
    """
    prices = frozen_prices(bars)
    ended = holdings(fills).withColumn("_end", bars.agg(F.max(session_date())).scalar())
    spans = ended.withColumn("_last", F.least(F.date_sub("until", 1), F.col("_end"))).filter(F.col("_last") >= F.col("from"))
    daily = spans.select("run_id", "symbol", "quantity", F.explode(F.sequence("from", "_last")).alias("date"))
    out = daily.join(prices, ["symbol", "date"])
    return out.select("run_id", "symbol", "date", "quantity", "price", (F.col("quantity") * F.col("price")).alias("market_value"))


def mark_to_market(positions: DataFrame, fills: DataFrame, bars: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """The ``__PORTFOLIO__`` row of every run and panel date: value, cash, equity, exposure and P&L."""
    flow = F.when(F.col("side") == "BUY", -F.col("quantity") * F.col("price")).otherwise(F.col("quantity") * F.col("price")) - F.coalesce("fees", F.lit(0.0))
    moves = fills.groupBy("run_id", session_date().alias("date")).agg(F.sum(flow).alias("_cash"))
    value = positions.groupBy("run_id", "date").agg(F.sum("market_value").alias("market_value"))
    dates = bars.select(session_date().alias("date")).distinct()
    span = [bars.agg(end(session_date())).scalar() for end in (F.min, F.max)]
    runs = fills.select("run_id").distinct().withColumn("_a", span[0]).withColumn("_b", span[1])
    grid = runs.select("run_id", F.explode(F.sequence("_a", "_b")).alias("date")).join(dates, "date", "left_semi")
    rows = grid.join(value, ["run_id", "date"], "left").na.fill(0.0, ["market_value"]).withColumn("_side", F.lit(1))
    both = rows.unionByName(moves.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_t", F.col("date").cast("timestamp"))
    cashed = scan(both, "run_id", ("_t", "_side"), [Running("_net", "sum", F.col("_cash"))]).filter("_side = 1")
    df = cashed.withColumn("cash", F.lit(capital) + F.coalesce("_net", F.lit(0.0)))
    df = df.withColumn("equity", F.col("cash") + F.col("market_value"))
    prior = scan(df, "run_id", ("_t",), [Running("_last", "last", F.col("equity"), inclusive=False)])
    return prior.select(
        "run_id", "date", F.lit("__PORTFOLIO__").alias("symbol"), "market_value", "cash", "equity",
        F.when(F.col("equity") > 0, F.col("market_value") / F.col("equity")).otherwise(0.0).alias("gross_exposure"),
        (F.col("equity") - F.coalesce("_last", F.lit(capital))).alias("daily_pnl"))


def gross_curve(curve: DataFrame, costs: DataFrame) -> DataFrame:
    """Cumulative cost added back to equity, and the return of that gross equity."""
    spent = costs.groupBy("run_id", "timestamp").agg(F.sum("total_cost").alias("_cost"))
    df = curve.join(spent, ["run_id", "timestamp"], "left").na.fill(0.0, ["_cost"])
    run = scan(df, "run_id", ("timestamp",), [
        Running("cumulative_cost", "sum", F.col("_cost")), Running("_prior", "last", F.col("equity"), inclusive=False)])
    gross, before = F.col("equity") + F.col("cumulative_cost"), F.col("_prior") + F.col("cumulative_cost") - F.col("_cost")
    return run.withColumns({"gross_equity": gross, "gross_return": F.coalesce(gross / F.nullif(before, F.lit(0.0)) - 1, F.lit(0.0))}).drop("_cost", "_prior")


def rebalance_summary(fills: DataFrame, targets: DataFrame | None = None, equity: DataFrame | None = None) -> DataFrame:
    """Turnover per run and execution time; targets held and share of equity replaced where given."""
    value = F.col("quantity") * F.col("price")
    side = lambda s: F.sum(F.when(F.col("side") == s, value).otherwise(0.0))
    out = fills.groupBy("run_id", "timestamp").agg(side("BUY").alias("buy_turnover"), side("SELL").alias("sell_turnover"), F.sum(value).alias("total_turnover"))
    if targets is not None:
        held = targets.groupBy("run_id", "timestamp").agg(F.sum((F.col("target_weight") > 0).cast("long")).alias("target_count"))
        out = out.join(held, ["run_id", "timestamp"], "left").na.fill(0, ["target_count"])
    if equity is not None:
        out = out.join(equity.select("run_id", "timestamp", "equity"), ["run_id", "timestamp"], "left")
        out = out.withColumn("replacement_pct", F.when(F.col("equity").isNotNull(), F.col("total_turnover") / F.greatest("equity", F.lit(1e-12))))
    return out


def asof_target(signals: DataFrame, times: DataFrame, key: str, at: str) -> DataFrame:
    """For each (key, time) the whole signal set of the latest signal time at or before it."""
    stamps = signals.select(key, F.col("timestamp").alias("_stamp")).distinct()
    hit = asof(times, stamps, key, at, "_stamp", ["_stamp"], seconds=86_400).select(*times.columns, F.col("_stamp").alias("timestamp"))
    return hit.filter("timestamp IS NOT NULL").join(signals, [key, "timestamp"])


def reconcile(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Expected, submitted, filled and rejected counts per run and trade date."""
    sent = orders.groupBy("run_id", F.to_date("requested_at").alias("trade_date")).agg(
        F.count(F.lit(1)).alias("submitted_orders"), F.sum((F.col("status") == "REJECTED").cast("long")).alias("rejected_orders"))
    done = fills.groupBy("run_id", F.to_date("timestamp").alias("trade_date")).agg(F.count(F.lit(1)).alias("filled_orders"))
    both = sent.join(done, ["run_id", "trade_date"], "full").na.fill(0)
    return both.withColumn("expected_orders", F.col("submitted_orders"))


# --- risk ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class RiskPolicy:
    """Default portfolio limits."""

    max_position_pct: float = 0.20
    max_gross_exposure_pct: float = 1.00
    max_daily_loss_pct: float = 0.03
    max_drawdown_pct: float = 0.15
    max_sector_exposure_pct: float = 0.40
    max_open_positions: int = 20
    max_var_pct: float = 0.02
    min_liquidity_crore: float = 0.0


# Required state fields and how each is checked.
RISK_FIELDS: Mapping[str, str] = {
    "capital": "positive", "requested_notional": "positive", "current_position_notional": "any", "daily_pnl": "any",
    "current_gross_exposure": "non_negative", "current_sector_exposure": "non_negative", "current_drawdown": "non_negative",
    "daily_turnover_crore": "non_negative", "estimated_portfolio_var_pct": "non_negative", "open_position_count": "non_negative",
}


def risk_decide(proposals: DataFrame, policy: RiskPolicy = RiskPolicy()) -> DataFrame:
    """PASS, MODIFY or REJECT with the smallest cap of nine rules and their reasons in rule order."""
    c, zero = F.col, F.lit(0.0)
    asked, capital, current = c("requested_notional"), c("capital"), c("current_position_notional")
    buy = c("order_side") == "BUY"
    opposed = ((current > 0) & ~buy) | ((current < 0) & buy)
    reducing = F.when(opposed, F.least(asked, F.abs(current))).otherwise(zero)
    df = proposals.withColumns({"_reduce": reducing, "_after": current + F.when(buy, asked).otherwise(-asked)})
    df = df.withColumns({"_increase": F.greatest(asked - c("_reduce"), zero)})
    df = df.withColumn("_pure", (c("_reduce") > 0) & (c("_increase") == 0))
    pure, reduce_, increase = c("_pure"), c("_reduce"), c("_increase")
    none = F.array().cast("array<string>")

    def rule(name: str, hit: Column, cap: Column, reasons: Column) -> Column:
        return F.struct(F.when(hit, cap).otherwise(asked).alias("cap"), F.when(hit, reasons).otherwise(none).alias("reasons")).alias(name)

    def text(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    def state(name: str, kind: str) -> Column:
        v = c(name).cast("double")
        wrong = F.isnan(v) | (F.abs(v) == float("inf"))
        if kind == "positive":
            wrong = wrong | (v <= 0)
        elif kind == "non_negative":
            wrong = wrong | (v < 0)
        return F.when(v.isNull(), f"MISSING_RISK_STATE:{name}").when(wrong, f"INVALID_RISK_STATE:{name}")

    faults = F.array_compact(F.array(*[state(n, k) for n, k in RISK_FIELDS.items()]))
    required = rule("required", ~pure & (F.size(faults) > 0), zero, faults)

    def reduce_only(name: str, breached: Column, code: str) -> Column:
        partial = F.when((reduce_ > 0) & (increase == 0), asked).when(reduce_ > 0, reduce_).otherwise(zero)
        why = F.when((reduce_ > 0) & (increase == 0), none).when(reduce_ > 0, text(code, "RISK_INCREASING_PORTION_REJECTED")).otherwise(text(code))
        return rule(name, breached, partial, why)

    def budget(name: str, limit: float, used: str, code: str) -> Column:
        free = F.greatest(capital * limit - F.coalesce(c(used), zero), zero)
        spent = free <= 0
        cap = F.when(spent, reduce_).otherwise(reduce_ + free)
        why = F.when(spent & (reduce_ > 0), text(code, "RISK_INCREASING_PORTION_REJECTED")).when(spent, text(code)).otherwise(text("notional_capped_by_risk_policy"))
        return rule(name, ~pure & (spent | (increase > free)), cap, why)

    limit = capital * policy.max_position_pct
    offset = F.when((current != 0) & (F.abs("_after") < F.abs(current)), F.abs(current)).otherwise(zero)
    position_cap = reduce_ + F.greatest(limit - offset, zero)
    over = ~pure & (F.abs("_after") > limit) & (position_cap < asked)
    blocked = lambda code: F.when(reduce_ > 0, text(code, "RISK_INCREASING_PORTION_REJECTED")).otherwise(text(code))
    rules = [
        required,
        reduce_only("loss", F.coalesce(c("daily_pnl"), zero) <= -capital * policy.max_daily_loss_pct, "DAILY_LOSS_REDUCE_ONLY"),
        reduce_only("drawdown", F.coalesce(c("current_drawdown"), zero) >= policy.max_drawdown_pct, "DRAWDOWN_REDUCE_ONLY"),
        budget("sector", policy.max_sector_exposure_pct, "current_sector_exposure", "sector_exposure_limit_reached"),
        budget("gross", policy.max_gross_exposure_pct, "current_gross_exposure", "gross_exposure_limit_reached"),
        rule("position", over, position_cap, F.when(limit <= 0, text("position_limit_reached")).otherwise(text("notional_capped_by_risk_policy"))),
        rule("count", ~pure & (F.coalesce(c("open_position_count"), F.lit(0)) >= policy.max_open_positions) & (current == 0), zero, text("max_open_positions_limit_reached")),
        rule("liquidity", ~pure & (c("daily_turnover_crore") < policy.min_liquidity_crore), reduce_, blocked("insufficient_daily_liquidity")),
        rule("var", ~pure & (c("estimated_portfolio_var_pct") > policy.max_var_pct), reduce_, blocked("var_limit_exceeded")),
    ]
    df = df.withColumn("_rules", F.array(*[r.alias("r") for r in rules]))
    first = F.get("_rules", F.lit(0))
    stopped = F.exists(first["reasons"], lambda r: r.startswith("MISSING_RISK_STATE"))
    all_reasons = F.array_distinct(F.flatten(F.transform("_rules", lambda r: r["reasons"])))
    df = df.withColumns({
        "_cap": F.when(stopped, zero).otherwise(F.least(asked, F.array_min(F.transform("_rules", lambda r: r["cap"])))),
        "_why": F.when(stopped, F.array_distinct(first["reasons"])).otherwise(all_reasons),
    })
    tolerance = F.greatest(capital * 1e-12, F.lit(1e-9))
    action = F.when(c("_cap") <= 0, "REJECT").when(c("_cap") + tolerance < asked, "MODIFY").otherwise("PASS")
    return df.withColumns({
        "action": action, "approved_notional": F.when(action == "REJECT", 0.0).when(action == "MODIFY", c("_cap")).otherwise(asked),
        "reasons": F.when(action == "PASS", text("within_conservative_limits")).otherwise(c("_why")),
    }).drop("_reduce", "_increase", "_after", "_pure", "_rules", "_cap", "_why")


def opening_observation(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Execution price of orders from the first trusted tick of the order's own session."""
    opening = ticks.groupBy("symbol", session_date("exchange_timestamp").alias("session_date")).agg(
        F.min_by(F.struct("ltp", "exchange_timestamp", "sequence_number", "quality_state"), F.struct("exchange_timestamp", "sequence_number")).alias("_o"))
    df = orders.join(opening, ["symbol", "session_date"], "left")
    good = F.col("_o").isNotNull() & (F.col("_o.quality_state") == "TRUSTED") & (F.col("_o.ltp") > 0)
    return df.withColumns({
        "base_price": F.when(good, F.col("_o.ltp")), "execution_source": F.when(good, "OBSERVED_TICK").otherwise("UNAVAILABLE"),
        "source_sequence_number": F.when(good, F.col("_o.sequence_number")), "rejection_reason": F.when(~good, "MISSED_LIVE_OPEN_PRICE"),
    }).drop("_o")


def risk_state(positions: DataFrame, marks: DataFrame, sectors: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Risk inputs per run and date: gross, largest sector, drawdown from peak, and the VaR proxy."""
    by_sector = positions.join(sectors, "symbol", "left").groupBy("run_id", "date", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector")).agg(
        F.sum(F.abs("market_value")).alias("_v"), F.count(F.lit(1)).alias("_n"))
    book = by_sector.groupBy("run_id", "date").agg(
        F.sum("_v").alias("current_gross_exposure"), F.max("_v").alias("current_sector_exposure"), F.sum("_n").alias("open_position_count"))
    df = marks.join(book, ["run_id", "date"], "left").na.fill(0, ["current_gross_exposure", "current_sector_exposure", "open_position_count"])
    df = df.withColumn("_t", F.col("date").cast("timestamp"))
    peaked = scan(df, "run_id", ("_t",), [Running("_peak", "max", F.col("equity"))])
    top = F.greatest(F.col("_peak"), F.lit(capital))
    var = F.lit(1.65 * 0.015) * F.sqrt(F.col("open_position_count") + 1) * F.col("current_gross_exposure") / capital
    return peaked.withColumns({
        "current_drawdown": F.greatest((top - F.col("equity")) / F.greatest(top, F.lit(1e-12)), F.lit(0.0)), "estimated_portfolio_var_pct": var,
    }).drop("_t", "_peak")


def budget_used(proposals: DataFrame, keys: Sequence[str] = ("run_id", "date")) -> DataFrame:
    """Gross budget already taken by better-ranked proposals of the same date.

    A run's proposals on one date are at most its universe, so the window is bounded.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("rank", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    return proposals.withColumn("used_before", F.coalesce(F.sum("requested_notional").over(w), F.lit(0.0)))
