"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Java and Python spell a word alike: a run without blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"_{stem}"
    while name in df.columns:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text stands alone, whole."""
    return cuts(sizes(texts), limit)


def cuts(bytes_: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of numbers with a sum of about ``limit``; a larger number stands alone."""
    size = np.cumsum(bytes_)
    start, n = 0, len(size)
    while start < n:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
        yield start, end
        start = end


def release() -> None:
    """Give memory that was freed back to the system: idle workers stay, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over a task's batches, giving back at the end what its worker has freed."""

    @wraps(run)
    def out(*args: object) -> Iterator[pa.RecordBatch]:
        yield from run(*args)
        release()

    return out


def batches(source: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    for batch in source:
        for start, end in slices(batch.column(text), limit):
            yield batch.slice(start, end - start)
