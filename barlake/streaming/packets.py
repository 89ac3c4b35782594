"""Binary tick packets to typed rows, vectorised per batch; works on tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Little-endian packet layouts, their modes, and exchange codes.
HEADER = [("mode", "u1"), ("exchange_type", "u1"), ("token", "S25"), ("sequence", "<i8"), ("exchange_ms", "<i8"), ("ltp", "<i8")]
QUOTE = [
    *HEADER, ("ltq", "<i8"), ("average", "<i8"), ("volume", "<i8"), ("buy_qty", "<f8"), ("sell_qty", "<f8"),
    ("open", "<i8"), ("high", "<i8"), ("low", "<i8"), ("close", "<i8"),
]
LEVEL = np.dtype([("flag", "<i2"), ("quantity", "<i8"), ("price", "<i8"), ("orders", "<i2")])
SNAP = [
    *QUOTE, ("last_trade", "<i8"), ("oi", "<i8"), ("oi_change", "<i8"), ("levels", LEVEL, (10,)),
    ("upper", "<i8"), ("lower", "<i8"), ("high_52w", "<i8"), ("low_52w", "<i8"),
]
SMALL_LEVEL = np.dtype([("quantity", "<i4"), ("price", "<i4"), ("orders", "<i2")])
DEPTH = [
    ("mode", "u1"), ("exchange_type", "u1"), ("token", "S25"), ("exchange_ms", "<i8"), ("received_ms", "<i8"),
    ("bids", SMALL_LEVEL, (20,)), ("asks", SMALL_LEVEL, (20,)),
]
LAYOUTS = {1: np.dtype(HEADER), 2: np.dtype(QUOTE), 3: np.dtype(SNAP), 4: np.dtype(DEPTH)}
MODES = {1: "LTP", 2: "QUOTE", 3: "SNAP_QUOTE", 4: "DEPTH20"}
EXCHANGES = {1: "NSE_CM", 2: "NSE_FO", 3: "BSE_CM", 4: "BSE_FO", 5: "MCX_FO", 7: "NCX_FO", 13: "CDE_FO"}
CURRENCY, CURRENCY_SCALE, SCALE = 13, 10_000_000.0, 100.0

_LEVELS = "array<struct<price:double,quantity:bigint,orders:int,flag:int>>"
PRICES = {"open": "day_open", "high": "day_high", "low": "day_low", "close": "day_close", "average": "average_traded_price"}
LIMITS = {"upper": "upper_circuit", "lower": "lower_circuit", "high_52w": "high_52w", "low_52w": "low_52w"}
SCHEMA = (
    "packet_id bigint, mode string, exchange string, token string, sequence_number bigint, exchange_ms bigint, received_ms bigint, ltp double, "
    "last_traded_qty bigint, cumulative_volume bigint, total_buy_qty double, total_sell_qty double, "
    + ", ".join(f"{c} double" for c in [*PRICES.values(), *LIMITS.values()])
    + f", last_trade_ms bigint, open_interest bigint, open_interest_change bigint, bids {_LEVELS}, asks {_LEVELS}, error string"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def _levels(rows: np.ndarray, scale: np.ndarray, flag: int, own_flag: bool) -> list[list[dict]]:
    out = []
    for levels, s in zip(rows, scale):
        picked = levels[levels["flag"] == flag] if own_flag else levels
        out.append([
            {"price": float(x["price"]) / s, "quantity": int(x["quantity"]), "orders": int(x["orders"]), "flag": flag} for x in picked])
    return out


def _decode(mode: int, ids: np.ndarray, blobs: list[bytes]) -> pd.DataFrame:
    rec = np.frombuffer(b"".join(blobs), dtype=LAYOUTS[mode])
    kind = rec["exchange_type"].astype(int)
    scale = np.where(kind == CURRENCY, CURRENCY_SCALE, SCALE)
    out = pd.DataFrame({
        "packet_id": ids, "mode": MODES[mode], "exchange": [EXCHANGES.get(k, f"EX_{k}") for k in kind],
        "token": [t.split(b"\x00")[0].decode("ascii", errors="ignore").strip() for t in rec["token"]], "exchange_ms": rec["exchange_ms"],
    })
    names = rec.dtype.names
    if "ltp" in names:
        out["ltp"], out["sequence_number"] = rec["ltp"] / scale, rec["sequence"]
    if "ltq" in names:
        out["last_traded_qty"], out["cumulative_volume"] = rec["ltq"], rec["volume"]
        out["total_buy_qty"], out["total_sell_qty"] = rec["buy_qty"], rec["sell_qty"]
    for source, target in {**PRICES, **LIMITS}.items():
        if source in names:
            out[target] = rec[source] / scale
    if "levels" in names:
        raw = rec["last_trade"]
        out["last_trade_ms"] = np.where(raw > 10**11, raw, raw * 1000)
        out["open_interest"], out["open_interest_change"] = rec["oi"], rec["oi_change"]
        out["bids"], out["asks"] = _levels(rec["levels"], scale, 1, True), _levels(rec["levels"], scale, 0, True)
    if "bids" in names:
        out["received_ms"] = rec["received_ms"]
        out["bids"], out["asks"] = _levels(rec["bids"], scale, 1, False), _levels(rec["asks"], scale, 0, False)
    return out


def _fault(blob: bytes) -> str | None:
    if len(blob) < 2:
        return "PACKET_TOO_SHORT"
    layout = LAYOUTS.get(blob[0])
    if layout is None:
        return "UNKNOWN_MODE"
    return None if len(blob) == layout.itemsize else "INVALID_PACKET_SIZE"


def decode_packets(raw: DataFrame, packet_id: str = "packet_id", payload: str = "payload") -> DataFrame:
    """One typed row per packet; a packet of the wrong mode or size becomes a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blobs = [bytes(b) for b in pdf[payload]]
            fault = np.array([_fault(b) for b in blobs], dtype=object)
            ids = pdf[packet_id].to_numpy()
            parts = [pd.DataFrame({"packet_id": ids[fault != None], "error": fault[fault != None]})]  # noqa: E711
            modes = np.array([b[0] if f is None else 0 for b, f in zip(blobs, fault)])
            for mode in LAYOUTS:
                at = np.flatnonzero(modes == mode)
                if at.size:
                    parts.append(_decode(mode, ids[at], [blobs[i] for i in at]))
            parts = [p for p in parts if len(p)]
            if parts:
                whole = pd.concat(parts, ignore_index=True).reindex(columns=FIELDS)
                ints = ["sequence_number", "exchange_ms", "received_ms", "last_traded_qty", "cumulative_volume", "last_trade_ms", "open_interest", "open_interest_change"]
                texts = ["mode", "exchange", "token", "error", "bids", "asks"]
                typed = whole.astype({**{c: "Int64" for c in ints}, **{c: object for c in texts}})
                yield typed.assign(**{c: typed[c].where(typed[c].notna(), None) for c in texts})

    return raw.select(packet_id, payload).mapInPandas(run, SCHEMA)
