"""Path-dependent rules over ordered rows, split into bounded blocks.

Some rules (a position latch with a stop) need the state left by the row before.  A block
of rows is first reduced to a small summary of what it does to *any* incoming state; the
summaries of one key are chained to find each block's incoming state; then every block is evaluated on its own.  Only the chain, one row per block, is
sequential, and the last block of a key is never summarised.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions import windows as w

State = dict


def run_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    summarise: Callable[[pd.DataFrame], dict],
    summary_schema: str,
    advance: Callable[[State, dict], State],
    initial: State,
    state_schema: str,
    emit: Callable[[pd.DataFrame, State], dict],
    emit_schema: str,
    block_rows: int | None = None,
    chunk: Column | None = None,
    seconds: int | None = None,
) -> DataFrame:
    """``df`` plus the columns of ``emit_schema``, evaluated in ``order`` per key.

    ``summarise(rows)`` describes one block, ``advance(state, summary)`` gives the state after
    it, and ``emit(rows, state)`` returns the new columns for a block entered in ``state``.
    """
    size = block_rows or w.BLOCK_ROWS
    keys = list(keys)
    indexed = w.index_rows(df, keys, order, chunk=chunk, seconds=seconds)
    blocked = indexed.withColumn(w.BLOCK, F.floor(F.col(w.INDEX) / size))
    needed = blocked.select(*keys, w.BLOCK, w.INDEX, *[c for c in inputs if c not in keys])

    rows = F.max(w.INDEX) if w.INDEX in df.columns else F.count(F.lit(1)) - 1
    final = df.groupBy(*keys).agg(F.floor(rows / size).alias("_final"))
    early = needed.join(final, keys).filter(F.col(w.BLOCK) < F.col("_final")).drop("_final")
    key_fields = [needed.schema[k] for k in keys]
    block_field = T.StructField(w.BLOCK, T.LongType())

    def fields(text: str) -> list[T.StructField]:
        return list(T._parse_datatype_string(text).fields)

    def one_summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(w.INDEX)
        head = {k: pdf[k].iloc[0] for k in [*keys, w.BLOCK]}
        return pd.DataFrame([{**head, **summarise(pdf)}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = dict(initial), []
        for row in pdf.sort_values(w.BLOCK).to_dict(orient="records"):
            state = advance(state, row)
            out.append({**{k: row[k] for k in keys}, w.BLOCK: row[w.BLOCK] + 1, **state})
        return pd.DataFrame(out)

    summaries = early.groupBy(*keys, w.BLOCK).applyInPandas(
        one_summary, T.StructType([*key_fields, block_field, *fields(summary_schema)])
    )
    states = summaries.groupBy(*keys).applyInPandas(chain, T.StructType([*key_fields, block_field, *fields(state_schema)]))
    named = states.select(*keys, w.BLOCK, F.struct(*list(initial)).alias("_state"))
    placed = blocked.join(named, [*keys, w.BLOCK], "left")
    flat = placed.select("*", F.col("_state").isNotNull().alias("_known"), *[F.col(f"_state.{f}").alias(f"_in_{f}") for f in initial])
    flat = flat.drop("_state")
    out_fields = fields(emit_schema)
    carried = [f for f in df.schema.fields if f.name not in {o.name for o in out_fields}]

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(w.INDEX).reset_index(drop=True)
        first = pdf.iloc[0]
        state = {f: first[f"_in_{f}"] for f in initial} if bool(first["_known"]) else dict(initial)
        return pdf[[f.name for f in carried]].assign(**emit(pdf, state))

    return flat.groupBy(*keys, w.BLOCK).applyInPandas(one_block, T.StructType([*carried, *out_fields]))
