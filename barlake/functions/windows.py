"""Ordered per-key computation that never puts one whole key into one task.

A plain ``Window.partitionBy("symbol")`` sends every row of a symbol to a single
task, which breaks when one symbol holds a third of the table.  The helpers here
cut each key into bounded pieces first:

* ``chunk``: a fixed span of time.  Cumulative functions run inside a chunk and
  are combined through a per-chunk summary that is many orders smaller than the
  data (``scan``).
* ``block``: a fixed number of rows.  Sliding frames run inside a block that also
  carries copies of the few rows before (and after) it (``series``).

Key columns must not be NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlake.session import broadcast_if_small, staged

BLOCK_ROWS = 65_536
CHUNK_SECONDS = 730 * 86_400

INDEX, BLOCK, CHUNK, HALO = "_idx", "_block", "_chunk", "_halo"


def cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def chunk_of(ts: str, seconds: int | None = None) -> Column:
    return F.floor(F.col(ts).cast("double") / F.lit(float(seconds or CHUNK_SECONDS))).cast("long")


def packed_chunks(df: DataFrame, keys: str | Sequence[str], ts: str, rows: int | None = None) -> DataFrame:
    """Add ``CHUNK``, numbered 0, 1, 2, ... per key in order of time, with about ``rows`` rows each at most.

    A chunk is found by its first second among those of its key (``chunk_starts``), of which there are as many as
    chunks, so the rows themselves are not shuffled for it.
    """
    return in_chunks(df, chunk_starts(df.select(*cols(keys), ts, F.lit(1).alias("_n")), keys, ts, rows), keys, ts)


def chunk_starts(times: DataFrame, keys: str | Sequence[str], ts: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """(keys, ``_starts``), the first seconds of the chunks of each key, from ``_n`` rows at each of its times; and the most of a key.

    Keys of at most ``rows`` rows are one chunk and are left out.  The rows of others are counted per day and days are
    packed up to the bound; a day over the bound is cut by seconds first, so a chunk has fewer than twice ``rows`` rows
    unless one second of a key has more.  Only counts are windowed: a window holds a key's days and the pieces of its
    busy days, or the seconds of one day.
    """
    keys, size = cols(keys), rows or BLOCK_ROWS
    day, second = "_day", "_second"
    total = F.sum("_n").alias("_n")
    large = times.groupBy(*keys).agg(total).filter(F.col("_n") > size).select(*keys)
    times = times.select(*keys, F.unix_date(F.to_date(ts)).cast("long").alias(day), F.unix_seconds(ts).alias(second), "_n")
    times = times.join(large, keys, "left_semi")
    days = times.groupBy(*keys, day).agg(total, F.min(second).alias("_start"))
    calm = days.filter(F.col("_n") <= size).select(*keys, day, "_start", "_n")
    busy = days.filter(F.col("_n") > size).select(*keys, day)
    seconds = times.join(busy, [*keys, day], "left_semi").groupBy(*keys, day, second).agg(total)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = seconds.withColumn("_piece", F.floor(before(Window.partitionBy(*keys, day).orderBy(second)) / size))
    cut = pieces.groupBy(*keys, day, "_piece").agg(F.min(second).alias("_start"), total).drop("_piece")
    along = Window.partitionBy(*keys).orderBy(day, "_start")
    packs = calm.unionByName(cut).withColumn("_pack", F.floor(before(along) / size))
    starts = packs.groupBy(*keys, "_pack").agg(F.min("_start").alias("_start"))
    found = staged(starts.groupBy(*keys).agg(F.array_sort(F.collect_list("_start")).alias("_starts")))
    return found, found.agg(F.max(F.size("_starts"))).first()[0] or 0


def in_chunks(df: DataFrame, found: tuple[DataFrame, int], keys: str | Sequence[str], ts: str) -> DataFrame:
    """Add ``CHUNK``: one less than the starts at or before a row, of those that ``chunk_starts`` found; by binary search."""
    starts, most = found
    placed = df.join(broadcast_if_small(starts, starts), cols(keys), "left").withColumn(CHUNK, F.lit(0))
    for bit in reversed(range(most.bit_length())):
        ahead = F.col(CHUNK) + (1 << bit)
        placed = placed.withColumn(CHUNK, F.when(F.get("_starts", ahead - 1) <= F.unix_seconds(ts), ahead).otherwise(F.col(CHUNK)))
    return placed.withColumn(CHUNK, F.greatest(F.col(CHUNK) - 1, F.lit(0)).cast("long")).drop("_starts")


def count_below(ordered: Column, value: Column) -> Column:
    """How many elements of an ascending array are under ``value``, by binary search."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.element_at(ordered, middle + 1) < value
        step = F.struct(F.when(under, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(middle).alias("hi"))
        return F.when(s["lo"] < s["hi"], step).otherwise(s)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), halve, lambda s: s["lo"])


def value_chunk(value: Column, per_unit: int = 256) -> Column:
    """A monotone bucket of a number, for ranking by value: fine near zero, log-wide far out."""
    return F.floor(F.asinh(value) * per_unit).cast("long")


def _ordering(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


@dataclass(frozen=True)
class Running:
    """One cumulative column: ``kind`` is sum, product, min, max, count or last."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _local(kind: str, value: Column, frame: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "count": F.count}[kind](value).over(frame)


def _total(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "count": F.count}[kind](value)


def _carry(kind: str, name: str, frame: WindowSpec) -> Column:
    merge = "sum" if kind == "count" else kind
    return _local(merge, F.col(name), frame)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        both = carry + local
    elif kind == "product":
        both = carry * local
    elif kind == "min":
        return F.least(carry, local)
    elif kind == "max":
        return F.greatest(carry, local)
    else:
        return F.coalesce(local, carry)
    return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(both)


def scan(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    specs: Iterable[Running],
    chunk: Column | None = None,
    seconds: int | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Cumulative columns over all earlier rows of a key, two-level and skew-safe.

    ``order`` is the total order inside a key; its first column is the timestamp that
    defines the chunk unless ``chunk`` (any expression monotone in ``order``) is given.
    A chunk column kept by an earlier scan is reused, which also reuses its shuffle.
    ``inclusive=False`` leaves the current row out.  ``count`` keeps long, empty is NULL
    for everything but count.
    """
    specs = list(specs)
    keys = cols(keys)
    base = df
    if chunk is not None:
        base = df.withColumn(CHUNK, chunk)
    elif CHUNK not in df.columns:
        base = df.withColumn(CHUNK, chunk_of(order[0], seconds))
    for i, s in enumerate(specs):
        base = base.withColumn(f"_v{i}", s.value)
    at = F.struct(*_ordering(order)) if len(order) > 1 else F.col(order[0])
    totals = base.groupBy(*keys, CHUNK).agg(
        *[_total(s.kind, F.col(f"_v{i}"), at).alias(f"_t{i}") for i, s in enumerate(specs)]
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys, CHUNK, *[_carry(s.kind, f"_t{i}", earlier).alias(f"_c{i}") for i, s in enumerate(specs)]
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*_ordering(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        "*",
        *[
            _local(s.kind, F.col(f"_v{i}"), upto if s.inclusive else before).alias(f"_l{i}")
            for i, s in enumerate(specs)
        ],
    )
    joined = local.join(carries, [*keys, CHUNK], "left")
    result = {}
    for i, s in enumerate(specs):
        value = _combine(s.kind, F.col(f"_c{i}"), F.col(f"_l{i}"))
        result[s.name] = F.coalesce(value, F.lit(0)).cast("long") if s.kind == "count" else value
    scratch = [f"_{p}{i}" for i in range(len(specs)) for p in "vlc"]
    if not keep_chunk:
        scratch.append(CHUNK)
    return joined.withColumns(result).drop(*scratch)


def index_rows(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    name: str = INDEX,
    chunk: Column | None = None,
    seconds: int | None = None,
) -> DataFrame:
    """0-based row number per key, as ``row_number() - 1`` would give.

    An index kept by an earlier step (``done(keep_index=True)``) is trusted and reused, so a
    chain of operators numbers its rows once, next to the scan, from two columns.
    """
    if name == INDEX and INDEX in df.columns:
        return df
    spec = Running(name, "count", F.lit(1))
    return scan(df, keys, order, [spec], chunk, seconds).withColumn(name, F.col(name) - 1)


def growth(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[str], ret: str, start: float = 1.0, seconds: int | None = None,
) -> DataFrame:
    """``equity`` = start * running product of (1 + ret) and ``drawdown`` from its running peak, in one pass.

    A chunk is summed up by its total growth and its highest growth, which is all the
    chunks after it need.
    """
    keys = cols(keys)
    base = df.withColumn(CHUNK, chunk_of(order[0], seconds))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*_ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_g", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(inside))
    local = local.withColumn("_top", F.max("_g").over(inside))
    at = F.struct(*_ordering(order))
    totals = local.groupBy(*keys, CHUNK).agg(F.max_by("_g", at).alias("_end"), F.max("_top").alias("_high"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    opened = totals.withColumn("_open", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)))
    carries = opened.withColumn("_peak", F.max(F.col("_open") * F.col("_high")).over(earlier)).drop("_end", "_high")
    joined = local.join(carries, [*keys, CHUNK], "left")
    level = F.col("_open") * F.col("_g")
    peak = F.greatest(F.col("_peak"), F.col("_open") * F.col("_top"))
    return joined.withColumns({"equity": F.lit(start) * level, "drawdown": level / peak - 1}).drop(CHUNK, "_g", "_top", "_open", "_peak")


@dataclass(frozen=True)
class Series:
    """Rows cut into blocks, with copies of neighbouring rows flagged as halo."""

    df: DataFrame
    keys: tuple[str, ...]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(INDEX)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n-1 before it."""
        return self.w.rowsBetween(-(n - 1), Window.currentRow)

    def prior(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.w.rowsBetween(-n, -1)

    def ahead(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1, n)

    def with_columns(self, values: dict[str, Column]) -> Series:
        return Series(self.df.withColumns(values), self.keys)

    def done(self, keep_index: bool = False) -> DataFrame:
        """Drop halo copies and helper columns."""
        own = self.df.filter(~F.col(HALO)).drop(HALO, BLOCK)
        return own if keep_index else own.drop(INDEX)


def series(
    df: DataFrame,
    keys: str | Sequence[str] = "symbol",
    order: Sequence[str] = ("timestamp",),
    lookback: int = 1,
    lookahead: int = 0,
    block_rows: int | None = None,
    chunk: Column | None = None,
    seconds: int | None = None,
) -> Series:
    """Cut every key into blocks so that frames up to ``lookback`` rows back are exact."""
    keys = cols(keys)
    size = max(block_rows or BLOCK_ROWS, lookback, lookahead, 1)
    indexed = index_rows(df, keys, order, chunk=chunk, seconds=seconds)
    offset, block = F.col(INDEX) % size, F.floor(F.col(INDEX) / size)
    copies = [F.struct(block.alias("b"), F.lit(False).alias("h"))]
    if lookback:
        copies.append(F.when(offset >= size - lookback, F.struct((block + 1).alias("b"), F.lit(True).alias("h"))))
    if lookahead:
        copies.append(F.when(offset < lookahead, F.struct((block - 1).alias("b"), F.lit(True).alias("h"))))
    placed = (
        indexed.withColumn("_place", F.explode(F.array_compact(F.array(*copies))))
        .withColumns({BLOCK: F.col("_place.b"), HALO: F.col("_place.h")})
        .drop("_place")
    )
    return Series(placed, tuple(keys))


def full(s: Series, fn: Column, value: Column | str, n: int) -> Column:
    """A frame aggregate that stays NULL until n non-NULL observations exist."""
    return F.when(F.count(value).over(s.rows(n)) == n, fn.over(s.rows(n)))


def zscore(s: Series, value: str, n: int) -> Column:
    """Distance from the n-row mean in population deviations; 0 where the deviation is 0."""
    spread = F.nullif(F.stddev_pop(value).over(s.rows(n)), F.lit(0.0))
    return F.coalesce((F.col(value) - F.avg(value).over(s.rows(n))) / spread, F.lit(0.0))


def _weight_block(decay: float) -> int:
    """Rows per weight block: beyond two blocks a weight is under double precision."""
    if decay <= 0:
        return 2
    return max(2, math.ceil(40.0 / (-2.0 * math.log(decay))))


def ema_lookback(span: int) -> int:
    return 3 * _weight_block(1.0 - 2.0 / (span + 1.0))


def smoothing_lookback(alpha: float) -> int:
    return 3 * _weight_block(1.0 - alpha)


def add_smoothing(s: Series, value: str, alpha: float, name: str, seeded: bool = True) -> Series:
    """y(t) = (1 - alpha)*y(t-1) + alpha*x(t) from window sums only.

    The recursion is expanded inside weight blocks, where decay**-j stays small, and the two
    preceding blocks supply the carry.  ``seeded`` starts at the first value, else at zero.
    """
    if alpha >= 1:  # nothing is carried over
        return s.with_columns({name: F.col(value)})
    decay = 1.0 - alpha
    size = _weight_block(decay)
    sub, part = f"_{name}_sub", f"_{name}_part"
    j = (F.col(INDEX) % size).cast("double")
    weight = F.when(F.col(INDEX) == 0, F.lit(1.0 if seeded else alpha)).otherwise(F.lit(alpha))
    df = s.df.withColumn(sub, F.floor(F.col(INDEX) / size))
    run = Window.partitionBy(*s.keys, BLOCK, sub).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    weighted = weight * F.col(value) * F.pow(F.lit(decay), -j)
    df = df.withColumn(part, F.sum(weighted).over(run) * F.pow(F.lit(decay), j))
    back = Window.partitionBy(*s.keys, BLOCK).orderBy(sub)
    last_part = F.max_by(part, INDEX)
    near = F.coalesce(last_part.over(back.rangeBetween(-1, -1)), F.lit(0.0))
    far = F.coalesce(last_part.over(back.rangeBetween(-2, -2)), F.lit(0.0))
    carry = near + F.lit(decay**size) * far
    df = df.withColumn(name, F.col(part) + F.pow(F.lit(decay), j + 1) * carry).drop(sub, part)
    return Series(df, s.keys)


def add_ema(s: Series, value: str, span: int, name: str) -> Series:
    """Recursive exponential mean, seeded by the first value."""
    return add_smoothing(s, value, 2.0 / (span + 1.0), name)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    strict: bool = False,
    seconds: int | None = None,
    prefix: str = "",
) -> DataFrame:
    """For each left row the latest right row of its key at or before it (before, if strict).

    Both sides are merged into one ordered sequence and the last right row is carried
    forward by ``scan``, so neither a hot key nor a wide range is ever one task.
    """
    keys = cols(keys)
    payload = F.struct(F.col(right_ts).alias("at"), *[F.col(v) for v in values])
    marked = right.select(
        *keys, F.col(right_ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_hit")
    )
    queried = left.select(
        *keys, F.col(left_ts).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_row")
    )
    merged = queried.unionByName(marked, allowMissingColumns=True)
    carried = scan(merged, keys, ("_at", "_side"), [Running("_seen", "last", F.col("_hit"))], seconds=seconds)
    return carried.filter(F.col("_row").isNotNull()).select(
        "_row.*", F.col("_seen.at").alias(f"{prefix}{right_ts}_asof"), *[F.col(f"_seen.{v}").alias(f"{prefix}{v}") for v in values]
    )


def first_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key; the rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*cols(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
