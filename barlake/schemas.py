"""Fixed schemas and the explicit projection onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S, _L, _TS = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BARS = _schema(
    symbol=_S, exchange=_S, timeframe=_S, timestamp=_TS, open=_D, high=_D, low=_D, close=_D, volume=_L,
    adjustment=_S, provider_name=_S, dataset_id=_S,
)
RAW_BARS = _schema(
    dataset_id=_S, symbol=_S, source_row_number=_L, timestamp=_S, open=_S, high=_S, low=_S, close=_S, volume=_S, raw_json=_S,
)
SIGNALS = _schema(
    timestamp=_TS, symbol=_S, target_weight=_D, target_position=_D, signal=_S, reason=_S, score=_D, rank=_D, feature_snapshot=_S,
)
FILLS = _schema(
    fill_id=_S, order_id=_S, run_id=_S, symbol=_S, timestamp=_TS, side=_S, quantity=_D, price=_D, fees=_D, slippage_bps=_D,
)
CURVE = _schema(
    run_id=_S, timestamp=_TS, close=_D, position=_D, gross_return=_D, net_return=_D, equity=_D, drawdown=_D,
    fold_id=_S, evidence_level=_S,
)
ACTIONS = _schema(
    symbol=_S, ex_date=T.DateType(), action_type=_S, share_multiplier=_D, dividend_amount=_D, source_id=_S,
)
TICKS = _schema(
    exchange=_S, token=_S, symbol=_S, mode=_S, exchange_timestamp=_TS, received_at=_TS, sequence_number=_L,
    ltp=_D, last_traded_qty=_L, cumulative_volume=_L,
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the columns the schema knows, cast them, and add the missing ones as NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
