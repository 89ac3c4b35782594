"""Writes: upserts as joins, partition replacement, archives, long and report forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.windows import first_per_key
from barlake.session import staged

IDENTITY = ("timestamp", "open", "high", "low", "close", "volume", "symbol", "timeframe", "exchange", "asset_class")


def upsert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """The rows to append when the first writer wins: the stored row, else the first by ``order``.

    Without an order equal keys are settled by all their columns, so a retry picks the same row.
    """
    fresh = incoming.join(target.select(*keys), list(keys), "left_anti")
    return first_per_key(fresh, keys, order or [F.col(c) for c in sorted(incoming.columns)])


def upsert_replace(target: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The table after the newest version of every key won."""
    both = target.unionByName(incoming, allowMissingColumns=True)
    return first_per_key(both, keys, [F.col(version).desc_nulls_last()])


def merge_provenance(target: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("provider_name", "dataset_id")) -> DataFrame:
    """Fill missing provenance only where the incoming prices are the same."""
    same = ("open", "high", "low", "close", "volume")
    new = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in (*same, *fields)])
    df = target.join(new, list(keys), "left")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    filled = {f: F.coalesce(f, F.when(equal, F.col(f"_n_{f}"))) for f in fields}
    return df.withColumns(filled).drop(*[f"_n_{c}" for c in (*same, *fields)])


def storeable_features(df: DataFrame, ids: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """Keys plus the numeric columns that are features, chosen from the schema."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in IDENTITY]
    return df.select(*ids, *numeric)


def features_long(df: DataFrame, group: str, ids: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """Wide to long: numeric features only, no NULLs."""
    wide = storeable_features(df, ids)
    values = [c for c in wide.columns if c not in ids]
    typed = wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    long = typed.unpivot(list(ids), values, "feature_name", "feature_value").dropna(subset=["feature_value"])
    return long.withColumn("feature_group", F.lit(group))


def flatten_quality(wide: DataFrame, checks: Sequence[str], keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """One row per (symbol, timeframe, check) with its count and a JSON detail."""
    typed = wide.select(*keys, *[F.col(c).cast("long").alias(c) for c in checks])
    long = typed.unpivot(list(keys), list(checks), "check_type", "issue_count")
    return long.withColumn("details", F.to_json(F.struct("check_type", F.col("issue_count").alias("count"))))


def write_bars(bars: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Parquet partitioned by timeframe and month, files sorted for pruning by symbol.

    Rows are range-partitioned, so a hot symbol or month is spread over several files.
    """
    df = bars.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    spread = df.repartitionByRange("timeframe", "month", "symbol", "timestamp").sortWithinPartitions("timeframe", "month", "symbol", "timestamp")
    spread.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("timeframe", "month").parquet(path)


def archive_bars(bars: DataFrame, before: Column, path: str) -> bool:
    """Append the bars older than the cutoff that the archive lacks; False if there are none.

    A trimmed source archived again leaves what is stored.  The rows to add are written once
    to the shared folder, counted there and counted again in the archive.
    """
    spark, keys = bars.sparkSession, ["symbol", "timeframe", "timestamp"]
    old = bars.filter(F.col("timestamp") < before)
    try:
        stored = spark.read.parquet(path).select(*keys)
        new, have = staged(old.join(stored, keys, "left_anti")), stored.count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new, have = staged(old), 0
    rows = new.count()
    if rows:
        write_bars(new, path)
        if spark.read.parquet(path).count() != have + rows:
            raise RuntimeError(f"the archive at {path} does not hold the rows written to it")
    return rows > 0


def replace_scope(df: DataFrame, path: str, scope: Sequence[str] = ("run_id", "fold_id"), cleared: DataFrame | None = None) -> None:
    """Rewrite the partitions present in ``df``, and empty those that ``cleared`` (scope columns) names besides.

    A rerun without rows thus leaves none of the old ones: pass the scopes that were run.
    Rows of a hot scope are salted over several files; the salt is not stored.
    """
    if cleared is not None:
        _drop_scopes(cleared.select(*scope).distinct().join(df.select(*scope).distinct(), list(scope), "left_anti"), path, scope)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    writer = salted.repartition(*scope, "_salt").drop("_salt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*scope).parquet(path)


def _drop_scopes(scopes: DataFrame, path: str, scope: Sequence[str]) -> None:
    """Delete partition folders, one per scope, through the file system of the path."""
    spark = scopes.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in scopes.toLocalIterator():
        folder = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else escape(str(row[c]))}" for c in scope)
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, folder), True)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str]) -> None:
    """Append the rows of ``incoming`` whose key the stored table lacks."""
    upsert_ignore(spark.read.parquet(path), incoming, keys).write.mode("append").parquet(path)
