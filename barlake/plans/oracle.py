"""The fixture views again, as ANSI SQL for the side-by-side check."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "lines": """
SELECT l.*, n_name AS symbol, r_name AS sector, l_extendedprice / l_quantity AS p,
       row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
    "bars": """
SELECT symbol, sector, 'X' AS exchange, '1d' AS timeframe,
       l_shipdate + INTERVAL 225 MINUTE AS timestamp, CAST(l_shipdate AS DATE) AS d,
       arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume, 'UNADJUSTED' AS adjustment,
       strftime(l_shipdate, '%Y-%m-%d') AS day
FROM lines GROUP BY symbol, sector, l_shipdate""",
    "benchmark_bars": "SELECT timestamp, avg(close) AS benchmark_close FROM bars GROUP BY timestamp",
    "actions": """
SELECT symbol, ex_date, action_type, share_multiplier, dividend_amount FROM (
  SELECT n_name AS symbol, n_nationkey AS i, DATE '1998-01-15' + n_nationkey AS ex_date, 'SPLIT' AS action_type,
         2.0::DOUBLE AS share_multiplier, NULL::DOUBLE AS dividend_amount FROM nation
  UNION ALL SELECT n_name, n_nationkey, DATE '2000-03-01' + n_nationkey, 'BONUS', 1.5, NULL FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT n_name, n_nationkey, DATE '1999-06-01' + n_nationkey, 'CONSOLIDATION', 0.5, NULL FROM nation WHERE n_nationkey % 7 = 0
  UNION ALL SELECT n_name, n_nationkey, (make_date(y::INT, 5, 1) + n_nationkey)::DATE, 'DIVIDEND', 1.0, 1.0 + n_nationkey / 10.0
            FROM nation, (VALUES (1997), (1999), (2001)) AS v(y))""",
    "constituents": """
SELECT 'ALL' AS universe_name, 'X:' || symbol || ':EQ' AS instrument_id, symbol, i::VARCHAR AS token, effective_from,
       effective_until, effective_from + 5 AS known_from FROM (
  SELECT n_name AS symbol, n_nationkey AS i, (DATE '1995-01-01' + 30 * n_nationkey) AS effective_from,
         CASE WHEN n_nationkey % 5 = 0 THEN DATE '1999-01-01' END AS effective_until FROM nation
  UNION ALL SELECT n_name, n_nationkey, DATE '2000-01-01', NULL FROM nation WHERE n_nationkey % 10 = 0)""",
    "fills": """
SELECT *, run_id || '-' || fill_no AS fill_id FROM (
  SELECT 'run-' || (o_custkey % 8) AS run_id, symbol, sector, l_shipdate AS timestamp,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, p AS price,
         l_extendedprice * l_tax / 100 AS fees, l_orderkey AS order_id, o_orderdate AS requested_at,
         l_linestatus AS exit_reason, o_orderpriority AS entry_reason, l_discount AS discount,
         row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY l_shipdate, symbol, k) AS fill_no
  FROM lines JOIN orders ON l_orderkey = o_orderkey)""",
    "round_trips": """
SELECT *, gross_pnl - entry_cost - exit_cost AS net_pnl FROM (
  SELECT fill_id AS trade_id, run_id, symbol, sector, least(requested_at, timestamp) AS entry_timestamp,
         greatest(requested_at, timestamp) AS exit_timestamp, quantity, price AS entry_price,
         price * (0.95::DOUBLE + discount) AS exit_price, fees AS entry_cost, fees / 2 AS exit_cost,
         quantity * (price * (0.95::DOUBLE + discount) - price) AS gross_pnl,
         abs(date_diff('day', requested_at, timestamp))::DOUBLE AS holding_period_days, entry_reason, exit_reason,
         CASE WHEN exit_reason = 'F' THEN 'RANK_REMOVAL' ELSE 'REBALANCE_REDUCTION' END AS exit_classification
  FROM fills)""",
    "attribution": """
SELECT run_id, symbol, sector, exit_timestamp AS timestamp, 'SELL' AS side, exit_reason AS reason, net_pnl AS realized_pnl,
       entry_cost + exit_cost AS cost, quantity, gross_pnl, holding_period_days, exit_classification,
       'wf-' || (year(exit_timestamp) - 1994) AS fold_id FROM round_trips""",
    "reviews": """
SELECT 'run-' || (o_custkey % 8) AS run_id, o_orderdate AS reviewed_at, o_orderkey AS review_no,
       CASE o_orderstatus WHEN 'F' THEN 'PAPER_CANDIDATE' WHEN 'O' THEN 'PAPER_ACTIVE' ELSE 'RESEARCH_ONLY' END AS stage,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'REJECT' ELSE 'PASS' END AS decision,
       o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS human_approved FROM orders""",
    "curve": """
SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY timestamp) - 1 AS drawdown FROM (
  SELECT run_id, timestamp, net_return, strftime(timestamp, '%Y-%m-%d') AS day,
         100000.0::DOUBLE * exp(sum(ln(1 + net_return)) OVER (PARTITION BY run_id ORDER BY timestamp)) AS equity,
         'wf-' || (year(timestamp) - 1994) AS fold_id, 'OUT_OF_SAMPLE' AS evidence_level
  FROM (SELECT 'run-' || r AS run_id, timestamp,
               ((n * 7919 + date_diff('day', DATE '1970-01-01', timestamp) * 104729 + r * 31) % 2001 - 1000) / 100000.0::DOUBLE AS net_return
        FROM (SELECT o_custkey % 8 AS r, o_orderdate AS timestamp, count(*) AS n FROM orders GROUP BY 1, 2)))""",
    "ticks": """
SELECT *, rn + rn // 10 AS sequence_number FROM (
  SELECT event_id, user_id::VARCHAR AS token, 'U' || user_id AS symbol, 'X' AS exchange, ts AS exchange_timestamp,
         ts + (event_id % 7) * INTERVAL 1 SECOND AS received_at, value AS ltp,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS last_traded_qty, CAST(ts AS DATE) AS session_date,
         CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER w AS BIGINT) AS cumulative_volume, row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))""",
    "numbered_bars": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS r FROM bars",
    "raw_text": """
SELECT 'ds-' || symbol AS dataset_id, symbol, r AS source_row_number,
       CASE WHEN r % 79 = 0 THEN '' ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS timestamp,
       CASE WHEN r % 83 = 0 THEN 'abc' ELSE open::VARCHAR END AS open,
       CASE WHEN r % 97 = 0 THEN (low - 1)::VARCHAR ELSE high::VARCHAR END AS high,
       low::VARCHAR AS low,
       CASE WHEN r % 73 = 0 THEN 'NaN' ELSE close::VARCHAR END AS close,
       CASE WHEN r % 89 = 0 THEN (-volume)::VARCHAR ELSE volume::VARCHAR END AS volume FROM numbered_bars""",
    "raw_bars": """
SELECT * FROM raw_text UNION ALL
SELECT * REPLACE (source_row_number + 1000000 AS source_row_number) FROM raw_text WHERE source_row_number % 71 = 70""",
    "cal_bounds": "SELECT min(l_shipdate)::DATE AS start_day, max(l_shipdate)::DATE AS end_day FROM lineitem",
    "overrides": """
SELECT make_date(y::INT, 1, 1) AS session_date, 'CLOSED' AS kind, NULL AS open_time, NULL AS close_time FROM years
UNION ALL SELECT make_date(y::INT, 12, 25), 'CLOSED', NULL, NULL FROM years
UNION ALL SELECT (make_date(y::INT, 11, 1) + ((13 - isodow(make_date(y::INT, 11, 1))) % 7)::INT)::DATE, 'SPECIAL_SESSION', '10:00', '11:00' FROM years""",
    "years": "SELECT unnest(range(year(start_day), year(end_day) + 1)) AS y FROM cal_bounds",
    "sessions": """
SELECT d AS session_date, coalesce(kind, 'REGULAR') AS kind,
       d + CASE WHEN kind = 'SPECIAL_SESSION' THEN INTERVAL 270 MINUTE ELSE INTERVAL 225 MINUTE END AS open_at,
       d + CASE WHEN kind = 'SPECIAL_SESSION' THEN INTERVAL 330 MINUTE ELSE INTERVAL 600 MINUTE END AS close_at,
       strftime(d, '%Y-%m-%d') AS day
FROM (SELECT unnest(generate_series(start_day, end_day, INTERVAL 1 DAY))::DATE AS d FROM cal_bounds)
LEFT JOIN overrides ON d = session_date
WHERE coalesce(kind, '') <> 'CLOSED' AND (isodow(d) <= 5 OR kind = 'SPECIAL_SESSION')""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it mentions, in dependency order."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...] = ()) -> None:
        for name, sql in known.items():
            if name not in order and name not in seen and re.search(rf"\b{name}\b", text):
                visit(sql, (*seen, name))
                if name not in order:
                    order.append(name)

    visit(body)
    recursive = "RECURSIVE " if any("RECURSIVE_MARK" in known[n] for n in order) else ""
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({known[n].replace('/*RECURSIVE_MARK*/', '')})" for n in order)
    return f"WITH {recursive}{parts}\n{body}"
