"""Queries that write files and read them back: JSON and CSV sources, archive, reports, replaced scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.plans import fixtures as fx
from barlake.plans.q_stream import workspace
from barlake.plans.registry import add
from barlake.sources import bars as src
from barlake.sources import tables as tb


def stored_actions(s, d):
    """Corporate actions as one JSON array a symbol, read back with the declared schema."""
    path = f"{workspace(s)}/actions"
    row = F.struct("symbol", "ex_date", "action_type", "share_multiplier", "dividend_amount")
    arrays = fx.corporate_actions(s, d).groupBy(F.col("symbol").alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return src.read_actions_json(s, path).withColumn("day", F.date_format("ex_date", "yyyy-MM-dd"))


add("io04_read_actions_json", stored_actions, "SELECT symbol, strftime(ex_date, '%Y-%m-%d') AS day, action_type, share_multiplier, dividend_amount FROM actions",
    "symbol day action_type", "share_multiplier dividend_amount")


def archived(s, d):
    """Bars before 1998 archived; then those before 1999 of a source that has lost its first years."""
    path = f"{workspace(s)}/archive"
    bars = fx.bars(s, d)
    tb.archive_bars(bars, F.lit("1998-01-01").cast("timestamp"), path)
    tb.archive_bars(bars.filter("year(timestamp) >= 1997"), F.lit("1999-01-01").cast("timestamp"), path)
    return src.read_bars(s, path, "1d")


add("io06_archive_bars", archived, "SELECT symbol, day, open, close, volume FROM bars WHERE timestamp < '1999-01-01'",
    "symbol day", "open close volume")


def reported(s, d):
    """A report of yearly volumes as CSV, read back with a fixed schema and a renamed column."""
    path = f"{workspace(s)}/report"
    yearly = fx.bars(s, d).groupBy("symbol", F.year("timestamp").alias("bar_year")).agg(F.sum("volume").cast("long").alias("volume"), F.max("close").alias("highest"))
    tb.write_report_csv(yearly, path)
    return src.read_csv_checked(s, path, yearly.schema, ["symbol", "year", "volume"], {"bar_year": "year"})


add("io14_write_report_csv", reported, "SELECT symbol, year(d) AS year, sum(volume) AS volume, max(close) AS highest FROM bars GROUP BY 1, 2", "symbol year", "volume highest")


def rerun(s, d):
    """All curves stored by (run_id, fold_id); then run-3 is run again, and run-5 without a result."""
    path = f"{workspace(s)}/curves"
    curve = fx.equity_curve(s, d).select("run_id", "fold_id", "timestamp", "net_return")
    tb.replace_scope(curve, path)
    again = curve.filter("run_id = 'run-3'").withColumn("net_return", F.col("net_return") * 2)
    tb.replace_scope(again, path, cleared=curve.filter("run_id IN ('run-3', 'run-5')").select("run_id", "fold_id"))
    return s.read.parquet(path).withColumn("fold_id", F.col("fold_id").cast("string"))


add("io15_replace_scope", rerun, "SELECT run_id, CAST(fold_id AS VARCHAR) AS fold_id, strftime(timestamp, '%Y-%m-%d') AS day, CASE WHEN run_id = 'run-3' THEN 2 ELSE 1 END * net_return AS net_return FROM curve WHERE run_id <> 'run-5'",
    "run_id fold_id day", "net_return")
