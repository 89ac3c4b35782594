"""Views over the test tables in the shapes the operators expect (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.windows import Running, growth, scan
from barlake.session import broadcast_if_small, prepare, sliced, slices, staged_parts

OPEN_OFFSET = "INTERVAL '3' HOUR + INTERVAL '45' MINUTE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    supplier = table(spark, sf, "supplier")
    named = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("s_suppkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    )
    # Spark estimates this three-way join by multiplying sizes and would rather ship the lines.
    return broadcast_if_small(named, supplier)


TIE_BREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def tie_break() -> Column:
    """A total order of the lines of one ship date."""
    return F.struct(*TIE_BREAK)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _spread(table(spark, sf, "lineitem"), "l_shipdate")
    return lines.join(_suppliers(spark, sf), lines.l_suppkey == F.col("s_suppkey"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small single-file input over the cores; inputs with enough splits are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _lines(spark, sf)
        .withColumns({"p": price(), "k": tie_break()})
        .groupBy("symbol", "sector", "l_shipdate")
        .agg(
            F.min_by("p", "k").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "k").alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
        .select(
            "symbol",
            "sector",
            F.lit("X").alias("exchange"),
            F.lit("1d").alias("timeframe"),
            (F.col("l_shipdate").cast("timestamp") + F.expr(OPEN_OFFSET)).alias("timestamp"),
            "open", "high", "low", "close", "volume",
            F.lit("UNADJUSTED").alias("adjustment"),
        )
    )


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).groupBy("timestamp").agg(F.avg("close").alias("benchmark_close"))


def corporate_actions(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("i"))
    day = lambda text: F.expr(f"DATE '{text}' + i")
    row = lambda when, kind, mult, div, text: F.when(
        when,
        F.struct(day(text).alias("ex_date"), F.lit(kind).alias("action_type"),
                 F.lit(mult).alias("share_multiplier"), div.cast("double").alias("dividend_amount")),
    )
    paid = F.lit(1.0) + F.col("i") / 10.0
    none, always = F.lit(None).cast("double"), F.lit(True)
    every = F.array(
        row(always, "SPLIT", 2.0, none, "1998-01-15"),
        row(F.expr("i % 3 = 0"), "BONUS", 1.5, none, "2000-03-01"),
        row(F.expr("i % 7 = 0"), "CONSOLIDATION", 0.5, none, "1999-06-01"),
        *[row(always, "DIVIDEND", 1.0, paid, f"{y}-05-01") for y in (1997, 1999, 2001)],
    )
    return nation.select("symbol", F.inline(F.array_compact(every)))


def constituents(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("i"))
    span = lambda start, end: F.struct(start.alias("effective_from"), end.alias("effective_until"))
    first = span(F.expr("DATE '1995-01-01' + 30 * i"), F.expr("CASE WHEN i % 5 = 0 THEN DATE '1999-01-01' END"))
    second = F.when(F.expr("i % 10 = 0"), span(F.expr("DATE '2000-01-01'"), F.expr("CAST(NULL AS DATE)")))
    spans = nation.select("symbol", "i", F.explode(F.array_compact(F.array(first, second))).alias("s"))
    return spans.select(
        F.lit("ALL").alias("universe_name"),
        F.concat(F.lit("X:"), F.col("symbol"), F.lit(":EQ")).alias("instrument_id"),
        "symbol",
        F.col("i").cast("string").alias("token"),
        "s.effective_from", "s.effective_until",
        F.expr("s.effective_from + 5").alias("known_from"),
    )


def _order_lines(spark: SparkSession, sf: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    key = lambda name: [F.col(name).cast("long")]
    lines, orders = sliced(_lines(spark, sf), key("l_orderkey"), part), sliced(table(spark, sf, "orders"), key("o_orderkey"), part)
    return lines.join(orders, F.col("l_orderkey") == orders.o_orderkey)


def _unshaped_fills(spark: SparkSession, sf: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Fills with the columns of the tables; ``fill_values`` follow from them."""
    return _order_lines(spark, sf, part).select(
        F.expr("concat('run-', o_custkey % 8)").alias("run_id"),
        "symbol", "sector",
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        "l_returnflag", "l_linestatus", "l_discount", "l_tax", "o_orderdate", "o_orderpriority", *TIE_BREAK,
    )


def fill_values() -> dict[str, Column]:
    return {
        "side": F.expr("CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END"),
        "quantity": F.col("l_quantity"),
        "price": price(),
        "fees": F.expr("l_extendedprice * l_tax / 100"),
        "entry_reason": F.col("o_orderpriority"),
    }


def stored_fills(spark: SparkSession, sf: str) -> DataFrame:
    """What a ledger needs of the fills, not numbered, with the columns of the tables; lines meet their orders in slices."""
    n = slices(table(spark, sf, "lineitem"), table(spark, sf, "orders"))
    kept = ["run_id", "symbol", "timestamp", "l_returnflag", "l_tax", "o_orderpriority", *TIE_BREAK]
    return staged_parts(_unshaped_fills(spark, sf, (i, n)).select(*kept) for i in range(n))


def fills(spark: SparkSession, sf: str, numbered: bool = False) -> DataFrame:
    """Fills; ``numbered`` adds a per-run number and the fill_id built from it.

    Rows are numbered as they are in the tables; what follows from their values is computed behind the shuffle.
    """
    base, values = _unshaped_fills(spark, sf), fill_values()
    if numbered:
        base = scan(base, "run_id", ("timestamp", "symbol", *TIE_BREAK), [Running("fill_no", "count", F.lit(1))], seconds=60 * 86_400)
    return base.select(
        "run_id", "symbol", "sector", "timestamp",
        *[values[name].alias(name) for name in ("side", "quantity", "price", "fees")],
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        F.col("l_linestatus").alias("exit_reason"),
        values["entry_reason"].alias("entry_reason"),
        F.col("l_discount").alias("discount"),
        *(["fill_no", F.concat_ws("-", "run_id", F.col("fill_no").cast("string")).alias("fill_id")] if numbered else [F.lit(None).cast("string").alias("fill_id")]),
    )


def round_trips(spark: SparkSession, sf: str, numbered: bool = False) -> DataFrame:
    f = fills(spark, sf, numbered).withColumns({
        "entry_timestamp": F.least("requested_at", "timestamp"),
        "exit_timestamp": F.greatest("requested_at", "timestamp"),
        "exit_price": F.col("price") * (F.lit(0.95) + F.col("discount")),
        "entry_cost": F.col("fees"),
        "exit_cost": F.col("fees") / 2,
    })
    gross = F.col("quantity") * (F.col("exit_price") - F.col("price"))
    return f.select(
        F.col("fill_id").alias("trade_id"), "run_id", "symbol", "sector",
        "entry_timestamp", "exit_timestamp", "quantity", F.col("price").alias("entry_price"),
        "exit_price", "entry_cost", "exit_cost",
        gross.alias("gross_pnl"),
        (gross - F.col("entry_cost") - F.col("exit_cost")).alias("net_pnl"),
        F.datediff("exit_timestamp", "entry_timestamp").cast("double").alias("holding_period_days"),
        "entry_reason", "exit_reason",
        F.expr("CASE WHEN exit_reason = 'F' THEN 'RANK_REMOVAL' ELSE 'REBALANCE_REDUCTION' END").alias("exit_classification"),
    )


def fold_of(ts: str) -> Column:
    return F.concat(F.lit("wf-"), (F.year(ts) - 1994).cast("string"))


def attribution(spark: SparkSession, sf: str) -> DataFrame:
    return round_trips(spark, sf).select(
        "run_id", "symbol", "sector",
        F.col("exit_timestamp").alias("timestamp"),
        F.lit("SELL").alias("side"),
        F.col("exit_reason").alias("reason"),
        F.col("net_pnl").alias("realized_pnl"),
        (F.col("entry_cost") + F.col("exit_cost")).alias("cost"),
        "quantity", "gross_pnl", "holding_period_days", "exit_classification",
        fold_of("exit_timestamp").alias("fold_id"),
    )


def promotion_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.expr("concat('run-', o_custkey % 8)").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("reviewed_at"),
        F.col("o_orderkey").alias("review_no"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'PAPER_CANDIDATE' WHEN 'O' THEN 'PAPER_ACTIVE' ELSE 'RESEARCH_ONLY' END").alias("stage"),
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN 'REJECT' ELSE 'PASS' END").alias("decision"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").alias("human_approved"),
    )


def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    days = orders.groupBy(F.expr("o_custkey % 8").alias("r"), F.col("o_orderdate").cast("timestamp").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("n")
    )
    d = F.datediff("timestamp", F.lit("1970-01-01").cast("date")).cast("long")
    ret = ((F.col("n") * 7919 + d * 104729 + F.col("r") * 31) % 2001 - 1000) / F.lit(100000.0)
    base = days.select(F.concat(F.lit("run-"), F.col("r")).alias("run_id"), "timestamp", ret.alias("net_return"))
    return growth(base, "run_id", ("timestamp",), "net_return", 100_000.0).select(
        "run_id", "timestamp", "net_return", "equity", "drawdown",
        fold_of("timestamp").alias("fold_id"),
        F.lit("OUT_OF_SAMPLE").alias("evidence_level"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    base = events.select(
        "event_id",
        F.col("user_id").cast("string").alias("token"),
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        F.lit("X").alias("exchange"),
        F.col("ts").cast("timestamp").alias("exchange_timestamp"),
        F.expr("CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, 0, event_id % 7)").alias("received_at"),
        F.col("value").alias("ltp"),
        F.get_json_object("props", "$.k").cast("long").alias("last_traded_qty"),
        F.to_date("ts").alias("session_date"),
    )
    order = ("exchange_timestamp", "event_id")
    run = scan(
        base, ("token", "session_date"), order,
        [Running("cumulative_volume", "sum", F.col("last_traded_qty")), Running("_rn", "count", F.lit(1))],
        seconds=3600,
    )
    return run.withColumn("sequence_number", F.col("_rn") + F.floor(F.col("_rn") / 10)).drop("_rn")


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as provider text with defects placed by row number; one dataset per symbol."""
    b = bars(spark, sf)
    numbered = scan(b, "symbol", ("timestamp",), [Running("r", "count", F.lit(1))])
    text = numbered.select(
        F.concat(F.lit("ds-"), F.col("symbol")).alias("dataset_id"), "symbol",
        F.col("r").alias("source_row_number"),
        F.expr("CASE WHEN r % 79 = 0 THEN '' ELSE date_format(timestamp, 'yyyy-MM-dd HH:mm:ss') END").alias("timestamp"),
        F.expr("CASE WHEN r % 83 = 0 THEN 'abc' ELSE CAST(open AS STRING) END").alias("open"),
        F.expr("CASE WHEN r % 97 = 0 THEN CAST(low - 1 AS STRING) ELSE CAST(high AS STRING) END").alias("high"),
        F.col("low").cast("string").alias("low"),
        F.expr("CASE WHEN r % 73 = 0 THEN 'NaN' ELSE CAST(close AS STRING) END").alias("close"),
        F.expr("CASE WHEN r % 89 = 0 THEN CAST(-volume AS STRING) ELSE CAST(volume AS STRING) END").alias("volume"),
    )
    twice = F.expr("CASE WHEN source_row_number % 71 = 70 THEN array(0, 1000000) ELSE array(0) END")
    return text.withColumn("_copy", F.explode(twice)).withColumn(
        "source_row_number", F.col("source_row_number") + F.col("_copy")).drop("_copy")


def calendar_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(bounds, overrides): the date range of the bars, and closed or special dates."""
    bounds = table(spark, sf, "lineitem").agg(
        F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end")
    )
    years = bounds.select(F.explode(F.expr("sequence(year(start), year(end))")).alias("y"))
    row = lambda day, kind, opens, closes: F.struct(
        F.expr(day).alias("session_date"), F.lit(kind).alias("kind"),
        F.lit(opens).cast("string").alias("open_time"), F.lit(closes).cast("string").alias("close_time"))
    overrides = years.select(F.inline(F.array(
        row("make_date(y, 1, 1)", "CLOSED", None, None),
        row("make_date(y, 12, 25)", "CLOSED", None, None),
        row("next_day(make_date(y, 10, 31), 'SAT')", "SPECIAL_SESSION", "10:00", "11:00"),
    )))
    return bounds, overrides
