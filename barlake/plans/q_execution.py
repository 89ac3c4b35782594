"""Cost, order, ledger, position and risk queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barlake.operators import execution as x
from barlake.operators import features as f
from barlake.plans import fixtures as fx
from barlake.plans import q_features as qf
from barlake.plans.registry import add
from barlake.session import discard, slices, staged

W = qf.W
SCHEDULES = x.dated(x.DEFAULT_SCHEDULES, [date(1995, 1, 1), date(1997, 6, 1), date(1999, 10, 1), date(2001, 4, 1)])


def costed(s, d):
    return x.cost_schedule_asof(fx.fills(s, d, numbered=True), SCHEDULES)


STT = "CASE WHEN timestamp < '1997-06-01' THEN 12.5 ELSE 10.0 END::DOUBLE"
EXCH = "CASE WHEN timestamp < '1999-10-01' THEN 0.325 WHEN timestamp < '2001-04-01' THEN 0.297 ELSE 0.30699 END::DOUBLE"
add("x01_cost_schedule_asof", lambda s, d: costed(s, d).select("fill_id", F.col("schedule.version").alias("version"), F.col("schedule.stt_sell_bps").alias("stt"), F.col("schedule.exchange_transaction_bps").alias("exch")),
    f"""SELECT fill_id, CASE WHEN timestamp < '1997-06-01' THEN 'delivery-2010-01' WHEN timestamp < '1999-10-01' THEN 'delivery-2016-06' WHEN timestamp < '2001-04-01' THEN 'delivery-2024-10' ELSE 'delivery-2026-04' END AS version,
    {STT} AS stt, {EXCH} AS exch FROM fills""", "fill_id version", "stt exch")


def participation():
    return F.expr("(CAST(quantity AS INT) % 10) / 100.0D")


PARTS = "((CAST(quantity AS INT) % 10) / 100.0::DOUBLE)"
IMPACT = f"(10.0 * least(greatest({PARTS}, 0), 0.05::DOUBLE) / 0.05::DOUBLE)"
COSTS = f"""SELECT *, brokerage + stt + exchange_transaction + sebi + ipft + dp_charge + gst + stamp_duty AS statutory_fees, spread + slippage + market_impact AS execution_drag,
 brokerage + stt + exchange_transaction + sebi + ipft + dp_charge + gst + stamp_duty + spread + slippage + market_impact AS total_cost FROM (
 SELECT *, 0.18::DOUBLE * (brokerage + exchange_transaction + sebi + ipft + dp_charge) AS gst FROM (
 SELECT *, least(20, greatest(5, n * 10 / 10000)) AS brokerage, n * {STT} / 10000 AS stt, n * {EXCH} / 10000 AS exchange_transaction, n * 0.01::DOUBLE / 10000 AS sebi, n * 0.00001::DOUBLE / 10000 AS ipft,
 CASE WHEN side = 'SELL' THEN 20.0 ELSE 0 END AS dp_charge, CASE WHEN side = 'BUY' THEN n * 1.5 / 10000 ELSE 0 END AS stamp_duty, n * 2 / 10000 AS spread, n * 3 / 10000 AS slippage, n * {IMPACT} / 10000 AS market_impact
 FROM (SELECT *, quantity * price AS n FROM fills)))"""
add("x02_cost_breakdown", lambda s, d: x.cost_breakdown(costed(s, d), F.col("quantity") * F.col("price"), F.col("side"), participation()),
    f"SELECT fill_id, {', '.join(x.COMPONENTS)}, statutory_fees, execution_drag, total_cost FROM costs", "fill_id", " ".join([*x.COMPONENTS, "statutory_fees", "execution_drag", "total_cost"]), costs=COSTS)
add("x03_execution_price",
    lambda s, d: x.execution_price(costed(s, d), F.when(F.col("order_id") % 50 == 0, 0.0).otherwise(F.col("price")), F.col("side"), F.when(F.col("order_id") % 77 == 0, -1.0).otherwise(participation())),
    f"""SELECT fill_id, CASE WHEN order_id % 50 = 0 THEN 'INVALID_PRICE' WHEN order_id % 77 = 0 THEN 'MAX_PARTICIPATION_EXCEEDED' END AS reject_code,
    CASE WHEN order_id % 50 <> 0 AND order_id % 77 <> 0 THEN price * CASE WHEN side = 'BUY' THEN 1 + (5 + {IMPACT}) / 10000 ELSE 1 - (5 + {IMPACT}) / 10000 END END AS execution_price FROM fills""",
    "fill_id reject_code", "execution_price")

UPS = f"SELECT *, CASE WHEN close > lag(close, 5) {W} THEN 0.5 ELSE 0.0 END::DOUBLE AS target_position FROM bars"
UV = {"ups": UPS}


def ups(s, d):
    return f.n_period_return(fx.bars(s, d), [5]).withColumn("target_position", F.when(F.col("ret_5") > 0, 0.5).otherwise(0.0)).drop("ret_5")


add("x04_next_bar_orders", lambda s, d: x.next_bar_orders(ups(s, d)).withColumns({"day": F.date_format("signal_timestamp", "yyyy-MM-dd"), "next_day": F.date_format("execution_timestamp", "yyyy-MM-dd")}),
    f"""SELECT symbol, day, strftime(nt, '%Y-%m-%d') AS next_day, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, nopen AS base_price, delta AS delta_position, close AS known_close, volume AS known_volume FROM (
    SELECT *, target_position - coalesce(lag(target_position) {W}, 0) AS delta, lead(open) {W} AS nopen, lead(timestamp) {W} AS nt FROM ups) WHERE delta <> 0 AND nt IS NOT NULL""",
    "symbol day next_day side", "base_price delta_position known_close known_volume", **UV)
DELTAS = f"""SELECT symbol, day, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, delta AS delta_position, pr AS price, abs(delta) * 100000 / pr AS requested_quantity, FRAC * abs(delta) * 100000 / pr AS quantity,
 FRAC * abs(delta) * 100000 * 4 / 10000 AS fees FROM (SELECT *, coalesce(lead(open) {W}, close) * (1 + sign(delta) * 5 / 10000) AS pr FROM deltas_src) WHERE delta <> 0"""
add("x05_signal_deltas", lambda s, d: x.signal_deltas(ups(s, d), fee_bps=4.0, cost_bps=5.0), DELTAS.replace("FRAC", "1"),
    "symbol day side", "delta_position price requested_quantity quantity fees", deltas_src=f"SELECT *, target_position - coalesce(lag(target_position) {W}, 0) AS delta FROM ups", **UV)
HELD = """/*RECURSIVE_MARK*/SELECT symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS held FROM (SELECT DISTINCT symbol FROM ups_rn)
 UNION ALL SELECT u.symbol, u.rn, h.held + 0.4::DOUBLE * (u.target_position - h.held) FROM held_rec h JOIN ups_rn u ON u.symbol = h.symbol AND u.rn = h.rn + 1"""
add("x05_signal_deltas_partial", lambda s, d: x.signal_deltas(ups(s, d), fee_bps=4.0, cost_bps=5.0, fraction=0.4), DELTAS.replace("FRAC", "0.4::DOUBLE").replace("delta <> 0", "abs(delta) > 1e-9"),
    "symbol day side", "delta_position price requested_quantity quantity fees", ups_rn=f"SELECT *, row_number() {W} AS rn FROM ups", held_rec=HELD,
    deltas_src="SELECT u.*, target_position - h.held AS delta FROM ups_rn u JOIN held_rec h ON h.symbol = u.symbol AND h.rn = u.rn - 1", **UV)


def sized(s, d):
    liquid = x.cost_schedule_asof(f.lagged_liquidity(fx.bars(s, d)), SCHEDULES)
    return liquid.withColumn("schedule", F.col("schedule").withField("minimum_daily_traded_value", F.lit(20_000.0)).withField("max_volume_participation", F.lit(0.03))).withColumn(
        "requested_quantity", (F.col("volume") % 4).cast("double"))


CAPQ = "least(volume % 4, floor(lagged_adv * 0.03::DOUBLE))"
add("x06_screen_capacity", lambda s, d: x.screen_capacity(sized(s, d)),
    f"""SELECT symbol, day, rejection_reason, CASE WHEN rejection_reason IS NOT NULL THEN 'REJECTED' WHEN {CAPQ} < volume % 4 THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS status,
    CASE WHEN rejection_reason IS NULL THEN {CAPQ} ELSE 0 END AS filled_quantity FROM (SELECT *, CASE WHEN lagged_adv IS NULL THEN 'INSUFFICIENT_HISTORY_FOR_CAPACITY' WHEN lagged_traded_value < 20000 THEN 'LIQUIDITY_REJECTION'
    WHEN {CAPQ} <= 0 THEN 'VOLUME_CAP_REJECTION' END AS rejection_reason FROM liq)""", "symbol day rejection_reason status", "filled_quantity", liq=qf.LIQ)
BT = f"""SELECT symbol, timestamp, day, target_position AS position, coalesce(close / lag(close) {W} - 1, 0) AS bar_return, coalesce(lag(target_position) {W}, 0) * coalesce(close / lag(close) {W} - 1, 0) AS gross_return,
 abs(target_position - coalesce(lag(target_position) {W}, 0)) AS turnover FROM SRC"""
BTN = "SELECT *, gross_return - turnover * 10 / 10000 AS net_return FROM bt"
BTE = f"SELECT *, sum(ln(1 + net_return)) {W} AS lg FROM btn"
BACK = {"bt": BT.replace("SRC", "ups"), "btn": BTN, "bte": BTE}
add("x07_vector_backtest", lambda s, d: x.vector_backtest(ups(s, d), cost_bps=10.0).withColumn("lg", F.log(F.col("equity") / 100_000)),
    f"SELECT symbol, day, gross_return, net_return, turnover, lg, exp(lg - greatest(lg, max(lg) {W})) - 1 AS drawdown FROM bte", "symbol day", "gross_return net_return turnover lg drawdown", **BACK, **UV)

FL = "SELECT *, fees + quantity * price * 5 / 10000 AS cost, quantity * price * 5 / 10000 AS drag, row_number() OVER (PARTITION BY run_id, symbol ORDER BY timestamp, fill_no) AS rn FROM fills"
CL = "CASE WHEN side = 'BUY' THEN 0 ELSE least(f.quantity, l.q) END"
LED = f"""/*RECURSIVE_MARK*/SELECT run_id, symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS q, 0.0::DOUBLE AS a, 0.0::DOUBLE AS c, 0.0::DOUBLE AS e, NULL::TIMESTAMP AS ent, NULL::VARCHAR AS er, 0.0::DOUBLE AS closed, 0.0::DOUBLE AS avg_out,
 0.0::DOUBLE AS ecost, 0.0::DOUBLE AS edrag, NULL::TIMESTAMP AS ent_out, NULL::VARCHAR AS er_out FROM (SELECT DISTINCT run_id, symbol FROM fl)
 UNION ALL SELECT f.run_id, f.symbol, f.rn, CASE WHEN side = 'BUY' THEN l.q + f.quantity ELSE l.q - {CL} END,
 CASE WHEN side = 'BUY' THEN (l.q * l.a + f.quantity * f.price + EXTRA) / greatest(l.q + f.quantity, 1e-12) WHEN l.q - {CL} = 0 THEN 0 ELSE l.a END,
 CASE WHEN side = 'BUY' THEN l.c + f.cost WHEN l.q - {CL} = 0 THEN 0 ELSE l.c - l.c * {CL} / greatest(l.q, 1e-12) END,
 CASE WHEN side = 'BUY' THEN l.e + f.drag WHEN l.q - {CL} = 0 THEN 0 ELSE l.e - l.e * {CL} / greatest(l.q, 1e-12) END,
 CASE WHEN side = 'BUY' AND l.q <= 0 THEN f.timestamp WHEN side = 'SELL' AND l.q - {CL} = 0 THEN NULL ELSE l.ent END, CASE WHEN side = 'BUY' AND l.q <= 0 THEN f.entry_reason WHEN side = 'SELL' AND l.q - {CL} = 0 THEN NULL ELSE l.er END,
 {CL}, CASE WHEN side = 'BUY' THEN (l.q * l.a + f.quantity * f.price + EXTRA) / greatest(l.q + f.quantity, 1e-12) ELSE l.a END,
 CASE WHEN side = 'BUY' THEN 0 ELSE l.c * {CL} / greatest(l.q, 1e-12) END, CASE WHEN side = 'BUY' THEN 0 ELSE l.e * {CL} / greatest(l.q, 1e-12) END,
 CASE WHEN side = 'BUY' AND l.q <= 0 THEN f.timestamp ELSE l.ent END, CASE WHEN side = 'BUY' AND l.q <= 0 THEN f.entry_reason ELSE l.er END
 FROM led l JOIN fl f ON f.run_id = l.run_id AND f.symbol = l.symbol AND f.rn = l.rn + 1"""
BOOK = """SELECT fl.*, l.closed AS closed_quantity, avg_out AS average_cost, ecost AS entry_cost, ent_out, er_out, CASE WHEN side = 'SELL' THEN (price - avg_out) * closed + edrag + drag ELSE 0 END AS gross_pnl
 FROM fl JOIN led l ON l.run_id = fl.run_id AND l.symbol = fl.symbol AND l.rn = fl.rn"""
LV = {"fl": FL, "led": LED.replace("EXTRA", "0"), "book": BOOK}


def of_fills(s, d, book, drop=(), **options):
    """A ledger of the fills, which are stored for it with their tables' columns and deleted when it has them in order."""
    raw = fx.stored_fills(s, d)
    values = {name: value for name, value in fx.fill_values().items() if name not in drop}
    if "entry_reason" in values:
        values["reason"] = values.pop("entry_reason")
    booked = book(raw, ties=fx.TIE_BREAK, values=values, parts=slices(raw), **options)
    discard(raw)
    return booked.withColumn("fill_id", F.concat_ws("-", "run_id", F.col("fill_no").cast("string")))


def booked(s, d):
    return of_fills(s, d, x.ledger, drag_bps=5.0)


def closings(s, d):
    return of_fills(s, d, x.trade_pnls, drop=["entry_reason"])


add("x08_ledger", lambda s, d: booked(s, d).withColumn("entered", F.date_format("entry_timestamp", "yyyy-MM-dd")),
    """SELECT fill_id, strftime(ent_out, '%Y-%m-%d') AS entered, er_out AS entry_reason, CASE WHEN side = 'SELL' THEN 'SIGNAL_FLIP' ELSE 'ENTRY' END AS exit_classification, closed_quantity, average_cost, entry_cost, gross_pnl,
    gross_pnl - cost AS realized_pnl, CASE WHEN side = 'SELL' THEN date_diff('day', ent_out, timestamp) END AS holding_period_days FROM book""",
    "fill_id entered entry_reason exit_classification", "closed_quantity average_cost entry_cost gross_pnl realized_pnl holding_period_days", digits=4, **LV)
add("x09_round_trips", lambda s, d: x.ledger_round_trips(booked(s, d)),
    "SELECT fill_id AS trade_id, run_id, symbol, er_out AS entry_reason, closed_quantity AS quantity, average_cost AS entry_price, price AS exit_price, gross_pnl, gross_pnl - entry_cost - cost AS net_pnl FROM book WHERE side = 'SELL' AND ent_out IS NOT NULL",
    "trade_id run_id symbol entry_reason", "quantity entry_price exit_price gross_pnl net_pnl", digits=4, **LV)
PNL = "SELECT fl.run_id, fl.symbol, fill_id, closed AS closed_quantity, (price - avg_out) * closed - fees AS pnl FROM fl JOIN led l ON l.run_id = fl.run_id AND l.symbol = fl.symbol AND l.rn = fl.rn WHERE side = 'SELL' AND closed > 0"
PV = {"fl": FL.replace("fees + quantity * price * 5 / 10000 AS cost", "fees AS cost"), "led": LED.replace("EXTRA", "f.cost"), "pnls": PNL}
add("x10_trade_pnls", closings, "SELECT * FROM pnls", "run_id symbol fill_id", "closed_quantity pnl", digits=4, **PV)

# Whole amounts, so that sums over a book are exact in any order.
def whole(s, d):
    down = lambda c: F.floor(c).cast("double")
    return (fx.fills(s, d).withColumns({"price": down("price"), "fees": down("fees")}), fx.bars(s, d).withColumn("close", down("close")))


DATES = "SELECT DISTINCT d FROM bars"
FROZEN = """SELECT symbol, d, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM (
 SELECT a.symbol, dates.d, b.close AS c FROM (SELECT symbol, min(d) AS f FROM wbars GROUP BY 1) a JOIN dates ON dates.d >= a.f LEFT JOIN wbars b ON b.symbol = a.symbol AND b.d = dates.d)"""
MOVES = "SELECT run_id, symbol, CAST(timestamp AS DATE) AS d, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS q FROM wfills GROUP BY 1, 2, 3"
POS = """SELECT * FROM (SELECT g.run_id, g.symbol, g.d, price, sum(coalesce(m.q, 0)) OVER (PARTITION BY g.run_id, g.symbol ORDER BY g.d) AS quantity FROM (
 SELECT s.run_id, f.symbol, f.d, f.price FROM frozen f JOIN (SELECT run_id, symbol, min(d) AS s0 FROM moves GROUP BY 1, 2) s ON s.symbol = f.symbol AND f.d >= s.s0) g
 LEFT JOIN moves m ON m.run_id = g.run_id AND m.symbol = g.symbol AND m.d = g.d) WHERE quantity <> 0"""
POSV = {"wbars": "SELECT * REPLACE (floor(close) AS close) FROM bars", "wfills": "SELECT * REPLACE (floor(price) AS price, floor(fees) AS fees) FROM fills", "dates": DATES, "frozen": FROZEN, "moves": MOVES, "pos": POS}


def held(s, d):
    return x.positions_at_close(*whole(s, d))


def day_of(df):
    return df.withColumn("day", F.date_format("date", "yyyy-MM-dd"))


add("x11_positions_at_close", lambda s, d: day_of(held(s, d)), "SELECT run_id, symbol, strftime(d, '%Y-%m-%d') AS day, quantity, price, quantity * price AS market_value FROM pos",
    "run_id symbol day", "quantity price market_value", digits=4, **POSV)
FLOW = "SELECT run_id, CAST(timestamp AS DATE) AS d, sum(CASE WHEN side = 'BUY' THEN -quantity * price ELSE quantity * price END - fees) AS cash FROM wfills GROUP BY 1, 2"
MARKS = """SELECT *, equity - coalesce(lag(equity) OVER (PARTITION BY run_id ORDER BY d), 100000) AS daily_pnl FROM (
 SELECT r.run_id, dates.d, coalesce(v, 0) AS market_value, 100000 + sum(coalesce(flow.cash, 0)) OVER (PARTITION BY r.run_id ORDER BY dates.d) AS cash, 100000 + sum(coalesce(flow.cash, 0)) OVER (PARTITION BY r.run_id ORDER BY dates.d) + coalesce(v, 0) AS equity
 FROM (SELECT DISTINCT run_id FROM wfills) r CROSS JOIN dates LEFT JOIN flow ON flow.run_id = r.run_id AND flow.d = dates.d LEFT JOIN (SELECT run_id, d, sum(quantity * price) AS v FROM pos GROUP BY 1, 2) p ON p.run_id = r.run_id AND p.d = dates.d)"""
MV = {**POSV, "flow": FLOW, "marks": MARKS}


def marks(s, d):
    return x.mark_to_market(staged(held(s, d)), *whole(s, d))


add("x12_mark_to_market", lambda s, d: day_of(marks(s, d)),
    "SELECT run_id, strftime(d, '%Y-%m-%d') AS day, '__PORTFOLIO__' AS symbol, market_value, cash, equity, CASE WHEN equity > 0 THEN market_value / equity ELSE 0 END AS gross_exposure, daily_pnl FROM marks",
    "run_id day symbol", "market_value cash equity gross_exposure daily_pnl", digits=3, **MV)
add("x13_gross_curve",
    lambda s, d: x.gross_curve(fx.equity_curve(s, d), fx.fills(s, d).select("run_id", "timestamp", F.col("fees").alias("total_cost"))),
    """SELECT run_id, day, cumulative_cost, equity + cumulative_cost AS gross_equity, coalesce((equity + cumulative_cost) / lag(equity + cumulative_cost) OVER (PARTITION BY run_id ORDER BY timestamp) - 1, 0) AS gross_return FROM (
    SELECT c.*, sum(coalesce(k, 0)) OVER (PARTITION BY c.run_id ORDER BY c.timestamp) AS cumulative_cost FROM curve c LEFT JOIN (SELECT run_id, timestamp, sum(fees) AS k FROM fills GROUP BY 1, 2) k ON k.run_id = c.run_id AND k.timestamp = c.timestamp)""",
    "run_id day", "cumulative_cost gross_equity gross_return", digits=5)
add("x14_rebalance_summary",
    lambda s, d: x.rebalance_summary(fx.fills(s, d), fx.fills(s, d).select("run_id", "timestamp", (F.col("quantity") - 10).alias("target_weight")), fx.equity_curve(s, d)),
    """SELECT f.run_id, strftime(f.timestamp, '%Y-%m-%d') AS day, sum(CASE WHEN side = 'BUY' THEN quantity * price ELSE 0 END) AS buy_turnover, sum(CASE WHEN side = 'SELL' THEN quantity * price ELSE 0 END) AS sell_turnover,
    sum(quantity * price) AS total_turnover, sum(CAST(quantity > 10 AS BIGINT)) AS target_count, sum(quantity * price) / max(equity) AS replacement_pct
    FROM fills f LEFT JOIN curve c ON c.run_id = f.run_id AND c.timestamp = f.timestamp GROUP BY 1, 2""", "run_id day", "buy_turnover sell_turnover total_turnover target_count replacement_pct", digits=4)


def monthly_sets(s, d):
    b = fx.bars(s, d).filter("dayofmonth(timestamp) = 1").select(F.lit("book").alias("key"), "timestamp", "symbol", (F.col("close") / 1e4).alias("target_weight"))
    times = fx.table(s, d, "orders").select(F.lit("book").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at")).distinct()
    return x.asof_target(b, times, "key", "at").withColumns({"day": F.date_format("at", "yyyy-MM-dd"), "signal_day": F.date_format("timestamp", "yyyy-MM-dd")})


add("x15_asof_target", monthly_sets,
    """SELECT strftime(o.a, '%Y-%m-%d') AS day, b.day AS signal_day, b.symbol, close / 1e4 AS target_weight FROM (SELECT a, (SELECT max(timestamp) FROM bars WHERE day(d) = 1 AND timestamp <= a) AS st FROM (SELECT DISTINCT o_orderdate AS a FROM orders)) o
    JOIN bars b ON b.timestamp = o.st AND day(b.d) = 1""", "day signal_day symbol", "target_weight")
add("x16_reconcile",
    lambda s, d: x.reconcile(fx.table(s, d, "orders").select(F.expr("concat('run-', o_custkey % 8)").alias("run_id"), F.col("o_orderdate").alias("requested_at"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'REJECTED' ELSE 'FILLED' END").alias("status")),
                             fx.fills(s, d)).withColumn("day", F.date_format("trade_date", "yyyy-MM-dd")),
    """SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.day, b.day) AS day, coalesce(n, 0) AS submitted_orders, coalesce(n, 0) AS expected_orders, coalesce(r, 0) AS rejected_orders, coalesce(k, 0) AS filled_orders FROM
    (SELECT 'run-' || (o_custkey % 8) AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS r FROM orders GROUP BY 1, 2) a
    FULL JOIN (SELECT run_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS k FROM fills GROUP BY 1, 2) b ON a.run_id = b.run_id AND a.day = b.day""", "run_id day", "submitted_orders expected_orders rejected_orders filled_orders")

# Proposals from orders, with every rule hit by some of them.
PROP = """o_orderkey AS proposal_id, o_totalprice AS requested_notional, 400000.0{D} AS capital,
 CASE o_orderkey % 5 WHEN 0 THEN 0.0{D} WHEN 1 THEN o_totalprice / 2 WHEN 2 THEN -o_totalprice / 2 WHEN 3 THEN o_totalprice * 2 ELSE -o_totalprice END AS current_position_notional,
 CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS order_side, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_custkey % 9) * 50000.0{D} END AS current_gross_exposure,
 (o_custkey % 7) * 30000.0{D} AS current_sector_exposure, CASE WHEN o_orderkey % 11 = 0 THEN -20000.0{D} ELSE 100.0{D} END AS daily_pnl, CASE WHEN o_orderkey % 17 = 0 THEN 0.2{D} WHEN o_orderkey % 19 = 0 THEN -0.1{D} ELSE 0.01{D} END AS current_drawdown,
 CASE WHEN o_orderkey % 23 = 0 THEN 25 ELSE 3 END AS open_position_count, CASE WHEN o_orderkey % 29 = 0 THEN 0.5{D} ELSE 9.0{D} END AS daily_turnover_crore, CASE WHEN o_orderkey % 31 = 0 THEN 0.05{D} ELSE 0.01{D} END AS estimated_portfolio_var_pct"""


def proposals(s, d):
    o = fx.table(s, d, "orders")
    return o.selectExpr(*[c.strip() for c in _split(PROP.replace("{D}", "D"))])


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


POLICY = x.RiskPolicy(min_liquidity_crore=1.0)
P0 = f"SELECT {PROP.replace('{D}', '::DOUBLE')} FROM orders"
P1 = """SELECT *, CASE WHEN (current_position_notional > 0 AND order_side = 'SELL') OR (current_position_notional < 0 AND order_side = 'BUY') THEN least(requested_notional, abs(current_position_notional)) ELSE 0 END AS red,
 current_position_notional + CASE WHEN order_side = 'BUY' THEN requested_notional ELSE -requested_notional END AS aft FROM p0"""
P2 = "SELECT *, greatest(requested_notional - red, 0) AS inc, red > 0 AND requested_notional - red <= 0 AS pure FROM p1"
REDO = "CASE WHEN red > 0 AND inc = 0 THEN requested_notional WHEN red > 0 THEN red ELSE 0 END"
P3 = f"""SELECT *, NOT pure AND current_gross_exposure IS NULL AS h_miss, NOT pure AND current_drawdown < 0 AS h_inv, daily_pnl <= -12000 AS h_loss, current_drawdown >= 0.15 AS h_dd, greatest(160000 - current_sector_exposure, 0) AS sfree, greatest(400000 - coalesce(current_gross_exposure, 0), 0) AS gfree,
 80000 - CASE WHEN current_position_notional <> 0 AND abs(aft) < abs(current_position_notional) THEN abs(current_position_notional) ELSE 0 END AS pfree FROM p2"""
P4 = """SELECT *, NOT pure AND (sfree <= 0 OR inc > sfree) AS h_sec, NOT pure AND (gfree <= 0 OR inc > gfree) AS h_gross, NOT pure AND abs(aft) > 80000 AND red + greatest(pfree, 0) < requested_notional AS h_pos,
 NOT pure AND open_position_count >= 20 AND current_position_notional = 0 AS h_cnt, NOT pure AND daily_turnover_crore < 1 AS h_liq, NOT pure AND estimated_portfolio_var_pct > 0.02 AS h_var FROM p3"""
P5 = f"""SELECT *, CASE WHEN h_miss THEN 0 ELSE least(requested_notional, CASE WHEN h_inv THEN 0 ELSE requested_notional END, CASE WHEN h_loss OR h_dd THEN {REDO} ELSE requested_notional END, CASE WHEN h_sec THEN CASE WHEN sfree <= 0 THEN red ELSE red + sfree END ELSE requested_notional END,
 CASE WHEN h_gross THEN CASE WHEN gfree <= 0 THEN red ELSE red + gfree END ELSE requested_notional END, CASE WHEN h_pos THEN red + greatest(pfree, 0) ELSE requested_notional END, CASE WHEN h_cnt THEN 0 ELSE requested_notional END,
 CASE WHEN h_liq OR h_var THEN red ELSE requested_notional END) END AS cap FROM p4"""
REJ = "CASE WHEN red > 0 THEN ['RISK_INCREASING_PORTION_REJECTED'] ELSE [] END"
PART_ = "CASE WHEN red > 0 AND inc = 0 THEN [] ELSE list_concat([{0}], CASE WHEN red > 0 THEN ['RISK_INCREASING_PORTION_REJECTED'] ELSE [] END) END"
WHY = f"""list_concat(CASE WHEN h_inv THEN ['INVALID_RISK_STATE:current_drawdown'] ELSE [] END, CASE WHEN h_loss THEN {PART_.format("'DAILY_LOSS_REDUCE_ONLY'")} ELSE [] END, CASE WHEN h_dd THEN {PART_.format("'DRAWDOWN_REDUCE_ONLY'")} ELSE [] END,
 CASE WHEN h_sec AND sfree <= 0 THEN list_concat(['sector_exposure_limit_reached'], {REJ}) WHEN h_sec THEN ['notional_capped_by_risk_policy'] ELSE [] END, CASE WHEN h_gross AND gfree <= 0 THEN list_concat(['gross_exposure_limit_reached'], {REJ}) WHEN h_gross THEN ['notional_capped_by_risk_policy'] ELSE [] END,
 CASE WHEN h_pos THEN ['notional_capped_by_risk_policy'] ELSE [] END, CASE WHEN h_cnt THEN ['max_open_positions_limit_reached'] ELSE [] END, CASE WHEN h_liq THEN list_concat(['insufficient_daily_liquidity'], {REJ}) ELSE [] END, CASE WHEN h_var THEN list_concat(['var_limit_exceeded'], {REJ}) ELSE [] END)"""
MISS = "list_concat(CASE WHEN current_gross_exposure IS NULL THEN ['MISSING_RISK_STATE:current_gross_exposure'] ELSE [] END, CASE WHEN current_drawdown < 0 THEN ['INVALID_RISK_STATE:current_drawdown'] ELSE [] END)"
add("x17_risk_decide", lambda s, d: x.risk_decide(proposals(s, d), POLICY).withColumn("reasons", F.array_join(F.sort_array("reasons"), ",")),
    f"""SELECT proposal_id, action, CASE action WHEN 'REJECT' THEN 0 WHEN 'MODIFY' THEN cap ELSE requested_notional END AS approved_notional,
    CASE WHEN action = 'PASS' THEN 'within_conservative_limits' ELSE array_to_string(list_sort(list_distinct(CASE WHEN h_miss THEN {MISS} ELSE {WHY} END)), ',') END AS reasons
    FROM (SELECT *, CASE WHEN cap <= 0 THEN 'REJECT' WHEN cap + 4e-7 < requested_notional THEN 'MODIFY' ELSE 'PASS' END AS action FROM p5)""", "proposal_id action reasons", "approved_notional", p0=P0, p1=P1, p2=P2, p3=P3, p4=P4, p5=P5)


def opening(s, d):
    t = fx.ticks(s, d).withColumn("quality_state", F.when(F.col("event_id") % 5 == 0, "UNTRUSTED").otherwise("TRUSTED"))
    days = t.select(f.session_date("exchange_timestamp").alias("session_date")).distinct()
    users = t.select("symbol").distinct()
    o = t.groupBy("symbol").agg(F.min(f.session_date("exchange_timestamp")).alias("a")).select("symbol", F.explode(F.sequence("a", F.date_add("a", 9))).alias("session_date"))
    return x.opening_observation(o, t).withColumn("day", F.date_format("session_date", "yyyy-MM-dd"))


TK = "SELECT *, (exchange_timestamp + INTERVAL 330 MINUTE)::DATE AS ld FROM ticks"
add("x18_opening_observation", opening,
    """SELECT g.symbol, strftime(g.dd, '%Y-%m-%d') AS day, CASE WHEN ok THEN 'OBSERVED_TICK' ELSE 'UNAVAILABLE' END AS execution_source, CASE WHEN NOT ok THEN 'MISSED_LIVE_OPEN_PRICE' END AS rejection_reason, CASE WHEN ok THEN p END AS base_price
    FROM (SELECT a.symbol, a.dd, t.p, coalesce(t.e % 5 <> 0 AND t.p > 0, false) AS ok FROM (SELECT symbol, (m + u::INT)::DATE AS dd FROM (SELECT symbol, min(ld) AS m FROM tk GROUP BY 1), (SELECT unnest(range(10)) AS u)) a
    LEFT JOIN (SELECT symbol, ld, arg_min(ltp, row(exchange_timestamp, sequence_number)) AS p, arg_min(event_id, row(exchange_timestamp, sequence_number)) AS e FROM tk GROUP BY 1, 2) t ON t.symbol = a.symbol AND t.ld = a.dd) g""",
    "symbol day execution_source rejection_reason", "base_price", tk=TK)
BOOKED = """SELECT run_id, d, sum(v) AS gross, max(v) AS sec, sum(n) AS cnt FROM (SELECT p.run_id, p.d, sector, sum(abs(quantity * price)) AS v, count(*) AS n FROM pos p JOIN (SELECT DISTINCT symbol, sector FROM bars) s ON s.symbol = p.symbol GROUP BY 1, 2, 3) GROUP BY 1, 2"""
add("x19_risk_state", lambda s, d: day_of(x.risk_state(held(s, d), staged(marks(s, d)), fx.bars(s, d).select("symbol", "sector").distinct())),
    """SELECT m.run_id, strftime(m.d, '%Y-%m-%d') AS day, coalesce(gross, 0) AS current_gross_exposure, coalesce(sec, 0) AS current_sector_exposure, coalesce(cnt, 0) AS open_position_count,
    greatest((pk - equity) / greatest(pk, 1e-12), 0) AS current_drawdown, 1.65 * 0.015 * sqrt(coalesce(cnt, 0) + 1) * coalesce(gross, 0) / 100000 AS estimated_portfolio_var_pct
    FROM (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY run_id ORDER BY d)) AS pk FROM marks) m LEFT JOIN booked b ON b.run_id = m.run_id AND b.d = m.d""",
    "run_id day", "current_gross_exposure current_sector_exposure open_position_count current_drawdown estimated_portfolio_var_pct", digits=2, booked=BOOKED, **MV)
