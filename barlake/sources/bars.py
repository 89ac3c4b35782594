"""Scans of bars, constituents and corporate actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.schemas import ACTIONS


def read_bars(spark: SparkSession, path: str, timeframe: str | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
    """Bars of one timeframe (a partition column) and optionally some symbols; both filters reach the scan."""
    return select_bars(spark.read.parquet(path), timeframe, symbols)


def select_bars(bars: DataFrame, timeframe: str | None = None, symbols: Sequence[str] | None = None) -> DataFrame:
    df = bars if timeframe is None else bars.filter(F.col("timeframe") == timeframe)
    return df if symbols is None else df.filter(F.col("symbol").isin(list(symbols)))


def read_bars_range(bars: DataFrame, start: Column, end: Column, adjustment: str | None = None) -> DataFrame:
    df = bars.filter(F.col("timestamp").between(start, end))
    return df if adjustment is None else df.filter(F.col("adjustment") == adjustment)


def range_problems(bars: DataFrame, start: Column, end: Column, tolerance_days: int = 7) -> DataFrame:
    """Per symbol: why a slice must be refused (mixed basis, or missing more than the tolerance at an end)."""
    gap = F.make_dt_interval(F.lit(tolerance_days))
    seen = bars.filter(F.col("timestamp").between(start, end)).groupBy("symbol").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_distinct("adjustment").alias("bases"))
    problems = F.array_compact(F.array(
        F.when(F.col("bases") > 1, "MIXED_ADJUSTMENT"),
        F.when(F.col("first") > start + gap, "COVERAGE_STARTS_LATE"),
        F.when(F.col("last") < end - gap, "COVERAGE_ENDS_EARLY"),
    ))
    return seen.select("symbol", F.explode(problems).alias("problem"))


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV with a fixed schema, renamed columns and a required-column check (no data is read for it)."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    for old, new in (rename or {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: number of rows and of distinct keys, to be compared by the caller."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return grouped.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("unique_keys"))


def read_actions_json(spark: SparkSession, path: str, schema: T.StructType = ACTIONS) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, dateFormat="yyyy-MM-dd")


RAW_JSON = "timestamp string, open string, high string, low string, close string, volume string"


def parse_raw_rows(raw: DataFrame) -> DataFrame:
    """Typed rows from the stored JSON, falling back to the text columns field by field."""
    parsed = F.from_json("raw_json", RAW_JSON)
    text = {c: F.coalesce(parsed[c], F.col(c)) for c in ("timestamp", "open", "high", "low", "close", "volume")}
    return raw.select(
        *[c for c in raw.columns if c not in text and c != "raw_json"],
        F.try_to_timestamp(F.nullif(F.trim(text["timestamp"]), F.lit(""))).alias("timestamp"),
        *[text[c].try_cast("double").alias(c) for c in ("open", "high", "low", "close")],
        text["volume"].try_cast("double").cast("long").alias("volume"),
    )
