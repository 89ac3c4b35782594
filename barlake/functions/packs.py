"""Ordered rows as one row of arrays per key and chunk.

A pass over ordered rows that are stored like this is a plain map: it needs neither a shuffle nor a sort, so rows
that several passes read are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barlake.functions.windows import CHUNK
from barlake.session import small_batches

# Rows of arrays are read and written many at a time, so they are kept short.
PACK_ROWS, OUT_ROWS = 8_192, 8_192
UPTO = "_upto"

Rows = dict[str, pa.Array]


def pack(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str],
    measure: Callable[[Rows], dict],
    measured: str,
    starts: DataFrame | None = None,
    number: str = "fill_no",
) -> DataFrame:
    """One row per ``keys`` and ``CHUNK``: the columns ``keep`` as arrays in ``order``, and the numbers that ``measure`` returns.

    ``starts`` (keys, ``CHUNK``, the first column of ``order``, ``UPTO``) adds the array ``number``: 1, 2, 3, ... beyond
    ``UPTO`` for the rows of one key and time, all of which must be in one chunk.
    """
    keys = list(keys)
    group, kinds = [*keys, CHUNK], {f.name: f.dataType for f in rows.schema.fields}
    if starts is not None:
        kinds[number] = T.LongType()
    listed = [*keep, *([number] if starts is not None else [])]
    scalars = list(T._parse_datatype_string(measured).fields)
    schema = T.StructType([
        *[rows.schema[k] for k in group], *scalars, *[T.StructField(c, T.ArrayType(kinds[c])) for c in listed]])
    at, sorting = order[0], [(c, "ascending") for c in order]

    def one(table: pa.Table, begins: pa.Table | None = None) -> pa.Table:
        table = table.sort_by(sorting, null_placement="at_start").combine_chunks()
        n = table.num_rows
        values = {c: _whole(table.column(c)) for c in keep}
        if begins is not None:
            begins = begins.sort_by(at)
            when, known = (_whole(t.column(at)).cast(pa.int64()).to_numpy(zero_copy_only=False) for t in (table, begins))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], when[1:] != when[:-1]]), np.arange(n), 0))
            upto = _whole(begins.column(UPTO)).to_numpy(zero_copy_only=False)[np.searchsorted(known, when)]
            values[number] = pa.array(upto + np.arange(n) - first + 1, pa.int64())
        found = measure(values)
        columns = [table.column(k).slice(0, 1) for k in group]
        columns += [pa.array([found[f.name]], to_arrow_type(f.dataType)) for f in scalars]
        columns += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values[c], type=to_arrow_type(T.ArrayType(kinds[c]))) for c in listed]
        return pa.table(columns, names=[f.name for f in schema.fields])

    if starts is None:
        return rows.groupBy(*group).applyInArrow(lambda table: one(table), schema)
    return rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInArrow(lambda left, right: one(left, right), schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.chunk(0) if whole.num_chunks else pa.array([], column.type)
    return whole


def over_packs(packs: DataFrame, fn: Callable[[dict, Rows], Mapping[str, object]], lists: Sequence[str], schema: T.StructType) -> DataFrame:
    """The rows that ``fn(scalars, arrays)`` makes of each row of ``packs``: per field of ``schema`` an array, or one value for all."""
    small_batches(packs.sparkSession)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    single = [c for c in packs.columns if c not in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                scalars = {c: batch.column(at[c])[i] for c in single}
                out = fn({c: v.as_py() for c, v in scalars.items()}, {c: _values(batch.column(at[c]), i) for c in lists})
                n = max((len(v) for v in out.values() if isinstance(v, pa.Array)), default=1)
                arrays = [_filled(out[name] if name in out else scalars[name], n, kind) for name, kind in fields]
                made = pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])
                for begin in range(0, n, OUT_ROWS):
                    yield made.slice(begin, OUT_ROWS)

    return packs.mapInArrow(run, schema)


def _values(lists: pa.ListArray, i: int) -> pa.Array:
    begin, end = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
    return lists.values.slice(begin, end - begin)


def _filled(value: object, n: int, kind: pa.DataType) -> pa.Array:
    if isinstance(value, pa.Array):
        return value if value.type == kind else value.cast(kind)
    if isinstance(value, pa.Scalar):
        return pa.repeat(value.cast(kind), n)
    return pa.repeat(pa.scalar(value, kind), n)
