"""Micro-batch sinks: upsert by key, quarantine routing, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from barlake.sources.tables import upsert_ignore
from barlake.streaming.admission import ACCEPT, quarantined


BATCH = "batch"


def _stored(batch: DataFrame, path: str, number: int) -> DataFrame | None:
    """What other batches have stored; None before the first."""
    try:
        return batch.sparkSession.read.parquet(path).filter(F.col(BATCH) != number)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


DAY = "key_day"


def upsert_batch(path: str, keys: Sequence[str], at: Column | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: store the rows whose key no other batch has.

    A batch owns the folders of its number and overwrites them, so a replay after a failure half-way
    replaces what was written instead of adding to it.  ``at`` is a time that the key determines: the table
    is then cut by its day too (``key_day``, "none" for null), and a batch reads only the days it has itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = _stored(batch, path, number)
        if at is not None:
            # read twice: kept, so that a stateful query runs its micro-batch once
            batch = batch.withColumn(DAY, F.coalesce(F.to_date(at).cast("string"), F.lit("none"))).persist()
            days = [r[0] for r in batch.select(DAY).distinct().collect()]  # calendar days of one micro-batch
            if table is not None:
                table = table.withColumn(DAY, F.col(DAY).cast("string")).filter(F.col(DAY).isin(days))
        fresh = batch.dropDuplicates(list(keys)) if table is None else upsert_ignore(table, batch, keys)
        if at is None:
            fresh.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
        else:
            parts = fresh.withColumn(BATCH, F.lit(number)).write.partitionBy(DAY, BATCH)
            parts.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
            batch.unpersist()

    return write


def sink_upsert(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, at: Column | None = None) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert_batch(path, keys, at))


def sink_bars(bars: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return sink_upsert(bars, path, ("symbol", "timeframe", "timestamp"), checkpoint, F.col("timestamp"))


def sink_snapshot(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Store every version that an update-mode stream emits; ``newest`` reads the current ones.

    As in ``sink_upsert`` a batch owns its folder, so a replay does not add versions.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def newest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the latest batch for every key of a snapshot table; one aggregation, combined before the shuffle."""
    values = [c for c in versions.columns if c not in (*keys, BATCH)]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row")).select(*keys, "_row.*")


def sink_ticks(ticks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return sink_upsert(ticks, path, ("exchange", "token", "sequence_number", "exchange_timestamp"), checkpoint, F.col("exchange_timestamp"))


def sink_admission(judged: DataFrame, accepted: str, held: str, checkpoint: str, keys: Sequence[str] = ("token", "event_id")) -> DataStreamWriter:
    """Accepted ticks to one table and the rest, with payload, to another."""

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        upsert_batch(accepted, keys)(batch.filter(F.col("action") == ACCEPT), number)
        upsert_batch(held, keys)(quarantined(batch), number)
        batch.unpersist()

    return judged.writeStream.option("checkpointLocation", checkpoint).foreachBatch(route)


def dead_letters(failed: DataFrame, error: str = "error") -> DataFrame:
    """Failed records with a key that is the same on every retry."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(failed.columns) if c != error]))
    key = F.concat_ws(":", "exchange", "token", F.col("sequence_number").cast("string"), F.unix_micros("exchange_timestamp").cast("string"), F.substring(F.sha2(body, 256), 1, 16))
    return failed.select(key.alias("idempotency_key"), body.alias("payload_json"), F.col(error).alias("error"))


def sink_dead_letter(failed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    micros = F.element_at(F.split("idempotency_key", ":"), -2).try_cast("bigint")
    return sink_upsert(dead_letters(failed), path, ("idempotency_key",), checkpoint, F.timestamp_micros(micros))
