"""Session defaults. A session handed in by a cluster keeps its own settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A table's bytes that one slice of it stands for, and the most slices: each of them reads the whole table.
SLICE_BYTES, MOST_SLICES = 512 * 1024 * 1024, 8


def local_session(app: str = "barlake", cores: int | str = "*", **conf: str) -> SparkSession:
    """Build a local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BARLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: every timestamp in this library is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand rows to Python workers in Arrow batches of about 1 MB; a session that sets its own size keeps it.

    By default a batch holds 10,000 rows: of texts that is tens of MB, which the executor builds beside its heap, once for
    each task, and the worker holds again.  Both keep much of such memory after the task.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(1 << 20))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; a local session without one gets a fresh folder.

    On a cluster a machine's own folder would be read back incomplete, so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = configured or tempfile.mkdtemp(prefix="spark-barlake-", dir="/tmp")
    context.setCheckpointDir(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared checkpoint folder once and read it back.

    For plans that use an expensive intermediate more than once: it is computed once, its
    lineage ends at files that outlive any executor, and later scans prune columns.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def staged_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """``staged`` for tables too large to be shuffled at once: each part is written before the next one is made.

    The shuffle files of a part are removed as soon as it is written, so the disk holds those of one part.
    """
    path = None
    for part in parts:
        spark = part.sparkSession
        path = path or f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
        before = spark.conf.get(TIDY, None)
        spark.conf.set(TIDY, "true")
        try:
            # small row groups: a row may be an array of thousands of values
            part.write.mode("append").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
        finally:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.parquet(path)


def discard(stage: DataFrame) -> None:
    """Delete the files of a table of ``staged`` or ``staged_parts`` that nothing will read again."""
    context = stage.sparkSession.sparkContext
    for name in {part for file in stage.inputFiles() for part in file.split("/") if part.startswith("stage-")}:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(stage.sparkSession)}/{name}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(*tables: DataFrame) -> int:
    """In how many slices to shuffle the largest of these tables, by its size in files."""
    size = max(_bytes(t) for t in tables)
    return max(1, min(MOST_SLICES, -(-size // SLICE_BYTES)))


def sliced(df: DataFrame, keys: Iterable[str], part: tuple[int, int]) -> DataFrame:
    """The rows of one slice: ``part`` is its number and how many there are; rows of equal keys are in the same one."""
    i, n = part
    return df if n == 1 else df.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, source: DataFrame, limit: int = 8 * 1024 * 1024) -> DataFrame:
    """Hint a broadcast only where the scan behind ``df`` is measured to be under ``limit`` bytes.

    ``df`` must not have more rows than ``source``.  Beyond the limit the join is left to Spark.
    """
    return F.broadcast(df) if _bytes(source) <= limit else df
